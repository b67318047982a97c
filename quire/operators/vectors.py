"""Vector table operators: hashed embeddings, upsert, delete, backfill.

The vector table is ``(entry_id, topic, line, embedding ARRAY<FLOAT>)``,
keyed by ``entry_id`` (two identical lines in a topic keep separate
vectors). An embedder is any ``Column -> Column`` producing ARRAY<FLOAT>;
the default is ``hash_embed_frame`` (JVM-side tokens, hashed and
counted by slices of Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.hashing import DEFAULT_DIM, check_dim, hash_params, token_bin
from quire.functions.text import token_slices, token_text, tokenize
from quire.operators.sizing import bounded_broadcast
from quire.session import cut_lineage

Embedder = Callable[[Column], Column]
MAX_CELLS = 4_000_000   # values of the vectors made at once


def token_bins(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """ARRAY<BIGINT>: the hash bin of every token, in order (JVM-side)."""
    return F.transform(tokenize(text), lambda t: token_bin(t, dim))


def hash_tokens(tokens: list[str] | pa.StringArray, dim: int) -> np.ndarray:
    """The bin of each token. All tokens advance together, one numpy step per
    byte position; the few that are much longer than the rest finish one by one."""
    seed, mult = hash_params(dim)
    mask = dim - 1
    raw = pa.array(tokens, pa.string()).cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset:raw.offset + len(raw) + 1].astype(np.int64) \
        if len(raw) else np.zeros(1, dtype=np.int64)
    lens = np.diff(ends)
    order = np.argsort(-lens, kind="stable")
    flat = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8) if len(raw) else np.zeros(0, dtype=np.uint8)
    at = ends[:-1][order]
    left = lens[order]
    h = np.full(len(raw), seed, dtype=np.int64)
    pos, active = 0, int(np.count_nonzero(left > 0))
    while active > 8:
        h[:active] = ((h[:active] ^ flat[at[:active] + pos]) * mult) & mask
        pos += 1
        active = int(np.searchsorted(-left, -pos, side="left"))  # tokens longer than pos
    for j in range(active):
        x = int(h[j])
        for byte in raw[int(order[j])].as_py()[pos:]:
            x = ((x ^ byte) * mult) & mask
        h[j] = x
    bins = np.empty(len(raw), dtype=np.int64)
    bins[order] = h
    return bins


def hash_embed_frame(df: DataFrame, text_col: str, keep: list[str], dim: int = DEFAULT_DIM,
                     out_col: str = "embedding") -> DataFrame:
    """``keep`` columns plus a dense hashed vector of ``text_col``.

    The text is lower-cased JVM-side (a projection); in ``mapInArrow`` the tokens stay
    in Arrow buffers, slice by slice (:func:`quire.functions.text.token_slices`):
    each distinct token of a slice is hashed once and the bins are counted with
    one numpy bincount. Narrow: no shuffle. ``token_bin`` is the same hash as a
    column expression (used for sparse rows and checked equal in tests).
    """
    check_dim(dim)
    staged = df.select(*keep, token_text(text_col).alias("_toks"))
    fields = [f for f in staged.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
    most = max(1, MAX_CELLS // dim)

    def fn(batches):
        for rows, lens, codes, distinct in token_slices(batches, "_toks", most):
            n = len(lens)
            bins = hash_tokens(distinct, dim)[codes] if len(codes) else codes
            counts = np.bincount(np.repeat(np.arange(n) * dim, lens) + bins, minlength=n * dim).astype(np.float32)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in keep] + [pa.ListArray.from_arrays(
                offsets, pa.array(counts))], names=keep + [out_col])

    return staged.mapInArrow(fn, schema)


def hash_embed_sparse(df: DataFrame, text_col: str, id_col: str = "entry_id",
                      dim: int = DEFAULT_DIM) -> DataFrame:
    """(id, bin, cnt): one row per non-empty bin. Exploded per token and
    counted with a map-side partial aggregate (rows of one id are
    co-located, so the shuffle carries at most ``dim`` rows per id)."""
    return (df.select(id_col, F.explode(token_bins(text_col, dim)).alias("bin"))
            .groupBy(id_col, "bin").agg(F.count(F.lit(1)).alias("cnt")))


def model_embedder(load_model: Callable[[], Callable[[list[str]], np.ndarray]],
                   dim: int) -> Embedder:
    """U1/U2: wrap a user model as an embedder. ``load_model`` runs once per
    Python worker (iterator-form pandas UDF) and returns a function mapping
    a list of texts to an (n, dim) array; texts arrive in Arrow batches."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            out = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
            yield pd.Series(list(out), index=texts.index)

    return lambda col: embed(col)


def embed_frame(df: DataFrame, text_col: str, keep: list[str], embed: Embedder | None = None,
                dim: int = DEFAULT_DIM, out_col: str = "embedding") -> DataFrame:
    """``keep`` + an embedding of ``text_col``: the user's embedder (a
    Column -> ARRAY<FLOAT> expression or pandas UDF) or the hashed default."""
    if embed is None:
        return hash_embed_frame(df, text_col, keep, dim, out_col)
    return df.select(*keep, embed(F.col(text_col)).alias(out_col))


def embed_entries(entries: DataFrame, embed: Embedder | None = None, text_col: str = "line",
                  dim: int = DEFAULT_DIM) -> DataFrame:
    """Vector rows for entries (stored vectors embed the full line)."""
    return embed_frame(entries, text_col, ["entry_id", "topic", "line"], embed, dim)


def vector_signature(embedding: Column | str) -> Column:
    """sum((i+1) * v[i]) in double: a compact fingerprint for comparing
    vector tables across engines without shipping arrays."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    return F.aggregate(F.zip_with(e, F.sequence(F.lit(1), F.size(e)),
                                  lambda v, i: v.cast("double") * i),
                       F.lit(0.0), lambda acc, x: acc + x)


def upsert(vectors: DataFrame, updates: DataFrame, key: str = "entry_id",
           version_col: str | None = None) -> DataFrame:
    """Insert-or-replace by ``key``: rows of ``updates`` replace rows of
    ``vectors`` with the same key; within ``updates`` the highest
    ``version_col`` wins (updates must be unique by key without it)."""
    if version_col is not None:
        cols = [c for c in updates.columns if c not in (key, version_col)]
        latest = updates.groupBy(key).agg(
            F.max_by(F.struct(*cols), version_col).alias("_row"))
        updates = latest.select(key, "_row.*")
    updates = cut_lineage(updates, "updates")  # read more than once; a lazy embedding runs once
    kept = vectors.join(bounded_broadcast(updates.select(key)), key, "left_anti")
    return kept.unionByName(updates.select(*vectors.columns))


def delete(vectors: DataFrame, removed: DataFrame, key: str = "entry_id") -> DataFrame:
    """Drop vectors whose key is in ``removed`` (anti-join). The keys are written
    once (an eager job); up to a broadcast's bound the vectors are not shuffled."""
    return vectors.join(bounded_broadcast(cut_lineage(removed.select(key), "removed-keys")), key, "left_anti")


def missing(entries: DataFrame, vectors: DataFrame, key: str = "entry_id") -> DataFrame:
    """Entries that have no vector yet."""
    return entries.join(vectors.select(key), key, "left_anti")


def backfill(entries: DataFrame, vectors: DataFrame, embed: Embedder | None = None,
             dim: int = DEFAULT_DIM) -> DataFrame:
    """Embed only entries lacking a vector, then upsert them (the reference
    re-embeds everything; the final table is the same)."""
    new = embed_entries(missing(entries, vectors), embed, dim=dim)
    return vectors.unionByName(new.select(*vectors.columns))  # all new keys: nothing to replace


def live_vectors(vectors: DataFrame, entries: DataFrame, key: str = "entry_id") -> DataFrame:
    """Vectors whose entry still exists (stale vectors are not searchable)."""
    return vectors.join(entries.select(key), key, "left_semi")
