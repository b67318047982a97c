"""Sum-of-squares packing of documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import doc_texts, materialise
from quire.llm.word_tokens import encoder

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def sum_of_squares_pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins.

    Items (lengths from 1 to ``capacity``) are placed longest first; each goes
    where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the
    number of open bins with g places left (full bins don't count). Moving a
    bin from gap g to g - s changes the sum by 2 (N(g - s) - N(g) + 1), a fill
    to the end by 1 - 2 N(g). Ties go to the smaller gap. A bin is opened only
    where no open one has room: with the longest items first that takes fewer
    bins than weighing a new bin by the same rule."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    counts = np.zeros(capacity + 1, dtype=np.int64)   # open bins by gap; gap 0 is closed and stays 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = np.arange(capacity + 1)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        if s == capacity:
            bins[i], offsets[i] = made, 0
            made += 1
            continue
        at = gaps[s:][counts[s:] > 0]
        gap = capacity
        if len(at):
            gap = int(at[np.where(at == s, 1 - 2 * counts[at], 2 * (counts[at - s] - counts[at] + 1)).argmin()])
        if gap == capacity:
            b = made
            made += 1
        else:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets, made


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its
    ids and ``end_id``, cut into pieces of ``capacity`` only where longer."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            rows = []
            for doc_id, ids in zip(doc_ids, enc.encode(b.column("text").to_pylist())):
                ids += end
                for piece, k in enumerate(range(0, len(ids), step)):
                    own = ids[k:k + step]
                    row = (doc_id, piece, k // 4, len(own) // 4, zlib.crc32(own))
                    rows.append(row + (own,) if keep_ids else row)
            cols = list(zip(*rows)) if rows else [[]] * (5 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=names[:len(cols)])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, _PIECES + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False, group: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])
    of every piece of every document: sequences of at most ``capacity`` ids.

    Pieces are dealt evenly, without regard to any key, into groups of about
    ``group`` pieces, and each group is packed on its own by the sum-of-squares
    rule; the group is large against the number of gaps, so the bins left open
    at its end are few. The groups grow in number, not in size. ``ids`` holds
    a piece's ids as little-endian unsigned 32-bit integers.

    Edge cases: a null or blank text is the end id alone; a document of
    exactly ``capacity`` ids is one piece; repeated rows and null doc_ids are
    packed like any other row; an empty table gives an empty result; other
    columns are not read."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    parts = max(1, -(-pieces.count() // group))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 33

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal base
            t = pa.Table.from_batches(held).combine_chunks()
            bins, offsets, made = sum_of_squares_pack(t.column("length").to_numpy(), capacity)
            t = t.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
            base += made
            return t.to_batches()[0]

        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= 4 * group:  # a partition far above its share is packed in parts
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    # round robin: equal shares whatever the keys; Spark sorts rows first, so a retried task deals alike
    return pieces.repartition(parts).mapInArrow(run, schema)
