"""Whitening of embeddings with a bidiagonal qd solver.

The covariance is never formed: tasks reduce blocks of centred rows to
triangular factors R by QR, the factors are stacked and reduced again until
one is left (R'R is n times the covariance), R is bidiagonalised by Householder
reflections, dqds finds its singular values to high relative accuracy, and
twisted factorisations give the directions (:mod:`quire.llm.bidiagonal`).

The driver holds one factor of d x d numbers; everything that grows with the
rows stays in tasks, which hold a batch and one factor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bidiagonal import right_singular
from quire.llm.common import materialise

SCALE, OFFSET = 64, 1_000_000
_LARGEST = 2.0 ** 56        # an entry of this size or more has no long SCALE * c
_FAN_CELLS = 1 << 22        # numbers in the factors that one task stacks


@dataclass
class Whitening:
    """Result of :func:`fit`: ``sums`` of the n integer vectors, ``directions``
    (d, k) as unit columns, ``variances`` falling, ``trace`` of the covariance."""
    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), d)


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, x array<bigint>) with x = floor(64 * c) + 1000000, the
    dimension). Dropped: vectors that are null, hold null or non-finite entries
    or entries of 2^56 or more in size, and vectors of another length than the
    most frequent one (the longer of equally frequent ones)."""
    c = F.col(vec_col)
    good = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                    & (F.abs(x.cast("double")) < _LARGEST))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.transform(c, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint") + OFFSET).alias("x"))
    rows = materialise(rows, "integer-vectors")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if usual is None:
        return rows, 0
    return rows.where(F.size("x") == usual.d), usual.d


def vector_sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(n, exact sums per dimension as Python integers)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("x"), d)
            n += len(x)
            high += (x >> 31).sum(axis=0)      # two halves, so that no sum of a partition overflows
            low += (x & 0x7FFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high]), pa.array([low])],
                                             names=["n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "n bigint, high array<bigint>, low array<bigint>")
    zipped = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    total = zipped.groupBy("at").agg(*[F.sum(c.cast("decimal(38,0)")).alias(a) for a, c in
                                       (("n", F.col("n")), ("high", F.col("s.high")), ("low", F.col("s.low")))]).collect()
    sums = np.zeros(d, dtype=object)
    for r in total:
        sums[r["at"]] = (int(r["high"]) << 31) + int(r["low"])
    return (int(total[0]["n"]) if total else 0), sums


def _centre(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as doubles; the whole part is subtracted as integers."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _reduced(blocks: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], cells: int) -> np.ndarray:
    """The blocks (at, data array<double>) merged in a tree whose tasks take
    as many at a time as hold ``_FAN_CELLS`` numbers."""
    fan = max(2, _FAN_CELLS // max(cells, 1))

    def run(pdf):
        import pandas as pd
        pdf = pdf.sort_values("at")
        out = merge([np.asarray(v) for v in pdf["data"]])
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0]) // fan], "data": [out]})

    blocks = materialise(blocks, "blocks")
    width = (blocks.agg(F.max("at")).first()[0] or 0) + 1
    while width > 1:
        blocks = materialise(blocks.groupBy(F.floor(F.col("at") / fan)).applyInPandas(run, blocks.schema), "blocks")
        width = -(-width // fan)
    found = blocks.collect()   # one block
    return np.asarray(found[0]["data"]) if found else np.zeros(0)


def triangular_factor(rows: DataFrame, d: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R (d, d) with R'R = sum of centred rows' outer products."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            if b.num_rows:
                r = np.linalg.qr(np.vstack([r, _centre(_matrix(b.column("x"), d), n, sums)]), mode="r")
        if len(r):
            full = np.zeros((d, d))
            full[:len(r)] = r
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([full.ravel()])], names=["at", "data"])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack([p.reshape(d, d) for p in parts]), mode="r").ravel()

    got = _reduced(rows.select("x").mapInArrow(run, "at bigint, data array<double>"), merge, d * d)
    return got.reshape(d, d) if len(got) else np.zeros((d, d))


def fit(rows: DataFrame, d: int, components: int = 32) -> Whitening:
    """Directions and variances of integer vectors. Directions without
    variance (beyond rounding) are left out."""
    n, sums = vector_sums(rows, d) if d else (0, np.zeros(0, dtype=object))
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    r = triangular_factor(rows, d, n, sums)
    squares, directions = right_singular(r)
    variances = squares / n
    k = min(components, len(variances))
    return Whitening(n, sums, directions[:, :k], variances[:k], float(variances.sum()))


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centre(x, model.n, model.sums) @ (model.directions / np.sqrt(model.variances))


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the
    identity. Each partition centres on its own mean; merging adds what the
    means differ by."""
    k = len(model.variances)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k)
        for b in batches:
            if b.num_rows:
                w = _whitened(_matrix(b.column("x"), d), model)
                mean = w.mean(axis=0)
                own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                total = merge([total, own])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              pa.array([total])], names=["at", "data"])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1:k + 1] for p in parts) / n
        squares = sum(p[k + 1:].reshape(k, k) + p[0] * np.outer(p[1:k + 1] - mean, p[1:k + 1] - mean) for p in parts)
        return np.concatenate([[n], mean, squares.ravel()])

    got = _reduced(rows.select("x").mapInArrow(run, "at bigint, data array<double>"), merge, 1 + k + k * k)
    return float(np.abs(got[k + 1:].reshape(k, k) / got[0] - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; none where it leaves long."""
    low, high = (np.array(f(sums, initial=0), dtype=object) for f in (np.min, np.max))
    reach = max(abs(n * int(x.min(initial=0)) - int(high)), abs(n * int(x.max(initial=0)) - int(low)),
                n * int(np.abs(x).max(initial=0)), *(abs(int(s)) for s in sums), 0)
    if reach < 1 << 62 and x.shape[1] * max(abs(n * int(v) - int(s)) for v, s in
                                            [*zip(x.max(axis=0), sums), *zip(x.min(axis=0), sums)]) ** 2 < 1 << 63:
        y = n * x - sums.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened_vectors(rows: DataFrame, d: int, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) of every integer vector."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), d)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), pa.array(_deviations(x, model.n, model.sums), pa.int64()),
                     pa.array(list(_whitened(x, model)), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    one row for each remaining vector and each of the first ``components``
    components, numbered from 1 by falling variance.

    Edge cases: dropped vectors as in :func:`integer_vectors`; a null id stays
    null, repeated rows stay repeated and all count; components without
    variance are left out, so a single vector, equal vectors, empty vectors
    and an empty table give no rows; components of equal variance are any
    orthonormal basis, the same for all rows; ``deviation`` is null where it
    leaves long; other columns are not read."""
    rows, d = integer_vectors(vectors, id_col, vec_col)
    model = fit(rows, d, components)
    schema = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    if not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, d, model)
    explained: Column = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.variances]),
                                     F.col("component"))
    return whitened_vectors(rows, d, model) \
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")) \
        .withColumn("component", F.col("at") + 1) \
        .select("vec_id", F.col("component").cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"),
                "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
