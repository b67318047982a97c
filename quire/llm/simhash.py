"""SimHash near-duplicate detection with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import (doc_texts, materialise, row_key, shuffle_width, sorted_runs, to_batch,
                              whole_row)
from quire.llm.graph import components

SEED = 42
BITS = 64
BROADCAST_ROWS = 100_000  # a table of two numbers a row is broadcast up to this many rows
_CHUNK = 1 << 16  # shingles hashed at once

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at ASCII
    white space, every shingle of ``shingle`` words (all words if fewer)
    hashed with XXH64; a bit is set if it is set in over half the hashes.
    A text without words has fingerprint 0."""
    words = text.lower().split()  # bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    first, last = starts[:n], ends[width - 1:]
    votes = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(first[k:k + _CHUNK].tolist(), last[k:k + _CHUNK].tolist())], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, row_key, fp bigint) of every row; a null text counts as empty.
    ``row_key`` identifies the row's doc_id and text (see :func:`row_key`)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("raw").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "row_key", "fp"])

    return doc_texts(docs, id_col, text_col) \
        .select("doc_id", row_key("doc_id", "text"), F.col("text").cast("binary").alias("raw")) \
        .mapInArrow(run, "doc_id bigint, row_key binary, fp bigint")


def deletion_variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, key bigint): every one-wildcard variant of every segment.

    With ``max_bits`` = d the 64 bits are cut into ``d // 2 + 1`` segments, so
    that of any pair within d bits one segment differs in at most one bit.
    Two such segments agree once that bit is masked, so a variant per bit
    (a hash of the bit's number and the segment without it) makes an equality
    key. Pairs that share a key are candidates only; they are verified."""
    parts = max_bits // 2 + 1
    cuts = [round(i * BITS / parts) for i in range(parts + 1)]
    low, high = F.lit(cuts[0]), F.lit(cuts[1])
    for a, b in zip(cuts[1:-1], cuts[2:]):
        low, high = F.when(F.col("bit") >= a, a).otherwise(low), F.when(F.col("bit") >= a, b).otherwise(high)
    one = F.lit(1).cast("bigint")
    v = fps.select("fp", F.explode(F.expr(f"sequence(0, {BITS - 1})")).alias("bit")) \
        .select("fp", "bit", low.alias("low"), (high - low).alias("width"))
    mask = F.when(F.col("width") == BITS, F.lit(-1).cast("bigint")) \
        .otherwise(F.call_function("shiftleft", one, F.col("width")) - 1)
    segment = F.call_function("shiftrightunsigned",
                              F.col("fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, F.col("bit")))),
                              F.col("low")).bitwiseAND(mask)
    return v.select("fp", F.xxhash64("bit", segment).alias("key"))


def _within(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fp``: breadth first, each node
    compared only with those not reached yet."""
    left = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= max_bits
            if near.any():
                out += [(at, int(x)) for x in left[near]]
                queue += left[near].tolist()
                left = left[~near]
    return out


def _links(max_bits: int, short: int = 48):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, lengths, cols in sorted_runs(batches, ["key"], ["fp"]):
            fp = cols[1].view(np.uint64)
            run_of = np.repeat(np.arange(len(starts)), lengths)
            rest = lengths[run_of] - (np.arange(len(fp)) - starts[run_of])  # rows from here to the end of the run
            rest[lengths[run_of] > short] = 0
            at = np.flatnonzero(rest > 1)
            us, vs = [], []
            d = 1
            while len(at):
                near = np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits
                us.append(fp[at[near]])
                vs.append(fp[at[near] + d])
                d += 1
                at = at[rest[at] > d]
            for r in np.flatnonzero(lengths > short):
                own = fp[starts[r]:starts[r] + lengths[r]]
                tree = np.array(_within(own, max_bits), dtype=np.int64).reshape(-1, 2)
                us.append(own[tree[:, 0]])
                vs.append(own[tree[:, 1]])
            if us:
                pair = np.stack([np.concatenate(us), np.concatenate(vs)]).view(np.int64)
                pair = np.unique(pair[:, pair[0] != pair[1]], axis=1)
                yield to_batch(_EDGE, [pair[0], pair[1]])

    return run


def links(fps: DataFrame, max_bits: int = 4, block: int = 8192) -> DataFrame:
    """(u, v): links among distinct fingerprints (column ``fp``) that connect
    all pairs within ``max_bits`` bits: variants are shuffled by key, and each
    sorted bucket yields a spanning forest of its verified pairs instead of
    all of them. A bucket above ``block`` fingerprints is cut into blocks and
    every pair of blocks becomes a bucket of its own, so no task holds more
    than two blocks of a key and no pair is lost."""
    parts = shuffle_width(fps)
    v = deletion_variants(fps.repartition(parts, "fp"), max_bits)
    hot = materialise(v.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
                      .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    n_hot = hot.count()
    if n_hot:
        own = F.pmod(F.hash("fp"), F.col("blocks")).cast("int")
        v = v.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left") \
            .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                           .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))) \
            .select("fp", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(
                F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other"))).alias("key"))
    return v.repartition(parts, "key").sortWithinPartitions("key", "fp") \
        .mapInArrow(_links(max_bits), "u bigint, v bigint")


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, row_key, fp) of every row, (fp, root) of every fingerprint)."""
    fp = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # written, so that the variants are made by all tasks, not by the few that the aggregate coalesces to
    own = materialise(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(links(own.select("fp"), max_bits))
    return fp, own.join(root, own.fp == root.node, "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``fingerprint`` is 16 lower-case hex digits; documents link when their
    fingerprints differ in at most ``max_bits`` bits, and ``component_id`` is
    the smallest doc_id reachable. Equal fingerprints are collapsed before any
    comparison, so exact copies cost one row each.

    Edge cases: a null or blank text has fingerprint zero and is linked like
    any other; repeated rows stay repeated; a null doc_id never becomes a
    component_id unless its whole component has none; an empty table gives an
    empty result; other columns are not read."""
    fp, rooted = _labelled(docs, id_col, text_col, shingle, max_bits)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fp.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         max_bits: int = 4) -> DataFrame:
    """``docs`` without near duplicates, all columns kept: of each component
    the row with the smallest doc_id stays (nulls last; then by a hash of the
    text), and a repeated row stays once. Links as in :func:`near_duplicates`."""
    fp, rooted = _labelled(docs, id_col, text_col, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    best = fp.groupBy("fp").agg(F.min(order).alias("best"))  # exact copies first, so a component gets few rows
    winners = best.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best")) \
        .select(F.col("best.row_key").alias("row_key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(whole_row(docs),
                         row_key(F.col(id_col).cast("bigint"), text))
    return packed.join(winners, "row_key", "left_semi").dropDuplicates(["row_key"]) \
        .select([F.col("row")[c].alias(c) for c in docs.columns])
