"""Ranking formulas as column expressions: BM25 term weight, IDF, boost,
reciprocal-rank fusion, cosine."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.dates import epoch_day
from quire.functions.text import entry_count, entry_date_part

# --- fixed values (must equal the reference's behaviour) -------------------
BM25_K1 = 1.2
BM25_B = 0.75
HALF_LIFE_DAYS = 365.0
REINFORCE_WEIGHT = 0.5
RRF_K = 60.0
CANDIDATE_DEPTH = 20
DEFAULT_LIMIT = 10
REAFFIRM_THRESHOLD = 0.95
SUPERSEDE_THRESHOLD = 0.85
# ---------------------------------------------------------------------------

# Scores are rounded before ranking so ties break the same way on every
# engine (summation order differs in the last bits).
SCORE_DIGITS = 6
# Best-match choices compare similarities to this many digits: enough to absorb the noise of
# double arithmetic, too few to let a lower similarity win.
TIE_DIGITS = 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idf(n_docs: Column | str, df: Column | str) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); always > 0."""
    n, d = _col(n_docs).cast("double"), _col(df).cast("double")
    return F.log((n - d + 0.5) / (d + 0.5) + 1.0)


def bm25_weight(idf_c: Column | str, tf: Column | str, dl: Column | str, avg_dl: Column | str,
                k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """idf * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avg_dl))."""
    tf_, dl_, avg = _col(tf).cast("double"), _col(dl).cast("double"), _col(avg_dl).cast("double")
    return _col(idf_c) * (tf_ * (k1 + 1.0)) / (tf_ + k1 * (1.0 - b + b * dl_ / avg))


def boost(line: Column | str, as_of_epoch_day: int | Column) -> Column:
    """Recency x reinforcement multiplier of an entry line.

    exp(-age/365 * ln 2) * (1 + 0.5 * ln(max(count, 1))), age clipped at 0.
    Exactly 1.0 when the line or its date does not parse (the counter is
    then ignored too).
    """
    today = as_of_epoch_day if isinstance(as_of_epoch_day, Column) else F.lit(int(as_of_epoch_day))
    # two small expressions, not the whole parse: the date is referenced
    # many times and each reference is a copy of its expression tree
    day = epoch_day(entry_date_part(line))
    age = F.greatest(today - day, F.lit(0)).cast("double")
    recency = F.exp(-age / HALF_LIFE_DAYS * math.log(2.0))
    reinforcement = 1.0 + REINFORCE_WEIGHT * F.log(F.greatest(entry_count(line), F.lit(1)).cast("double"))
    return F.when(day.isNotNull(), recency * reinforcement).otherwise(F.lit(1.0))


def rrf(rank0: Column | str, k: float = RRF_K) -> Column:
    """Reciprocal-rank term with a 0-based rank: the top hit adds 1/k."""
    return 1.0 / (_col(rank0).cast("double") + k)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two ARRAY<FLOAT/DOUBLE> columns, in double precision.

    0.0 when lengths differ, either is empty, or either has zero norm.
    For a handful of pairs; large products go through block matrix
    products in ``quire.operators.similarity``.
    """
    a, b = _col(a), _col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot / (na * nb)).otherwise(F.lit(0.0))


def rounded(c: Column | str, digits: int = SCORE_DIGITS) -> Column:
    return F.round(_col(c), digits)


def round_half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round`` of a double: half away from zero on its shortest
    decimal form. Only values close to a half are looked at one by one."""
    scaled = values * 10.0 ** digits
    out = np.floor(np.abs(scaled) + 0.5)
    near = np.abs(np.abs(scaled) - np.floor(np.abs(scaled)) - 0.5) < 1e-6
    for at in zip(*np.nonzero(near)):
        exact = Decimal(repr(abs(float(values[at])))).scaleb(digits)
        out[at] = int(exact.to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, scaled) / 10.0 ** digits
