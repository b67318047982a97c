"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back. The plan
    runs once, and a lost executor re-reads files instead of recomputing."""
    return cut_lineage(df, f"llm-{name}")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written and done:
    its cleaner drops them once the driver's JVM has collected their plans,
    which otherwise may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string); a null text is the empty text. Only the
    two named columns are read, so other columns may have any name."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct named ``row``; names may hold dots
    or back-ticks."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def text_key(text: Column) -> Column:
    """128-bit identity of a text."""
    return F.unhex(F.md5(text))


def row_key(doc_id, text) -> Column:
    """128-bit identity of a row by its doc_id (may be null) and text, never
    null, as a column named ``row_key``."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))) \
        .alias("row_key")


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str], values: list[str],
                block_rows: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Walk a partition that is sorted by ``keys`` and yield blocks of whole
    runs: (start of each run, length of each run, the value columns). A run
    (rows with equal keys) is never cut; a block holds about ``block_rows``
    rows, or one run if that is longer."""
    names = keys + values
    pending: list[list[np.ndarray]] = []
    held = 0

    def blocks(cols: list[np.ndarray], final: bool):
        n = len(cols[0])
        if not n:
            return None, cols
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in cols[:len(keys)]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        if not final:
            last = starts[-1]
            if last == 0:
                return None, cols
            rest = [c[last:] for c in cols]
            starts, cols = starts[:-1], [c[:last] for c in cols]
        else:
            rest = [c[:0] for c in cols]
        lengths = np.diff(np.append(starts, len(cols[0])))
        return (starts, lengths, cols), rest

    for batch in batches:
        if not batch.num_rows:
            continue
        pending.append([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names])
        held += batch.num_rows
        if held >= block_rows:
            cols = [np.concatenate(c) for c in zip(*pending)]
            got, rest = blocks(cols, False)
            pending, held = [rest], len(rest[0])
            if got:
                yield got
            else:  # one long run: wait for twice as many rows before looking again
                block_rows = max(block_rows, 2 * held)
    if pending:
        got, _ = blocks([np.concatenate(c) for c in zip(*pending)], True)
        if got:
            yield got


def list_lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start, end, flat values) of a list column; a null list is empty."""
    offsets = column.offsets.to_numpy()
    return offsets[:-1], offsets[1:], column.values


class RecentCache:
    """A bounded mapping of two generations: when the young one is full it
    becomes the old one, so entries in use survive and memory stays bounded."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def lookup(self, keys: Iterable) -> tuple[dict, list]:
        """(known entries among keys, keys not known)."""
        young, old, known, missing = self.young, self.old, {}, []
        for k in keys:
            v = young.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                young[k] = v
            known[k] = v
        return known, missing

    def add(self, entries: dict) -> None:
        self.young.update(entries)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
