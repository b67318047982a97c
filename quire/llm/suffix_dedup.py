"""Removal of long repeated byte strings by blockwise suffix sorting over a
difference cover.

Every suffix of every text is compared to a fixed depth (``length`` bytes).
The cover is a set D of residues mod v such that for any two places x, y some
shift d < v puts both x + d and y + d on the cover. So two suffixes that share
``length`` bytes also share the ``length - v + 1`` bytes at a cover place, d
bytes on. The steps:

1. Cover sample: every cover place is ranked by its next ``length - v + 1``
   bytes. At a bounded depth only equality matters, so the rank is the class
   of equal windows: the sample is shuffled into buckets by a hash of the
   window, a bucket is sorted at a time, and classes with one member drop out.
   A window's repeats within one text are dealt evenly instead, so a class
   brings a bucket one row a text at most, one of some 250 rows of that text.
2. Long ties: each member of a class is aligned with the class's first
   member. Aligned classes that follow each other along a text prove a whole
   stretch equal to an earlier one, without comparing its suffixes one by one.
3. Suffix buckets: the remaining suffixes with a repeated cover place ahead
   are keyed by a 128-bit hash of their ``length`` bytes and sorted block by
   block, bucket by bucket; runs of two or more are repeats.

A sorted bucket is streamed, so memory holds a block of a bucket, not a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import (list_lengths, materialise, release_shuffles, shuffle_width, sorted_runs, text_key,
                              to_batch, whole_row)

# fixed values: perfect difference sets, every residue mod the period is a difference of two members
COVERS = {183: np.array([0, 1, 3, 16, 23, 28, 42, 76, 82, 86, 119, 137, 154, 175]),
          91: np.array([0, 1, 3, 9, 27, 49, 56, 61, 77, 81]),
          31: np.array([0, 1, 3, 8, 12, 18])}
_BLOCK = 1 << 20  # bytes of one text hashed at once

_ONCE, _AGAIN = -1, -2  # a window's first place in its text: the only one, or of several
_SAMPLE = pa.schema([("h", pa.int64()), ("ord", pa.int64()), ("pos", pa.int64()), ("first", pa.int64())])
_TIE = pa.schema([("ord", pa.int64()), ("pos", pa.int64()), ("to_ord", pa.int64()), ("to_pos", pa.int64())])
_SPAN = pa.schema([("ord", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_SUFFIX = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ord", pa.int64()), ("p", pa.int64())])


class WindowHash:
    """Polynomial hashes mod 2^64 of windows of one length, over bytes mapped
    to random odd numbers; places are hashed in blocks of bounded size."""

    def __init__(self, seed: int, length: int):
        rng = np.random.default_rng(seed)
        self.length = length
        self.letter = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        inverse = pow(base, -1, 1 << 64)
        self.power = self._powers(base, _BLOCK + length)
        self.unpower = self._powers(inverse, _BLOCK + 1)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def __call__(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hashes of text[p:p + length] for ascending ``places``."""
        out = np.empty(len(places), dtype=np.uint64)
        k = 0
        while k < len(places):
            low = int(places[k])
            n = int(np.searchsorted(places, low + _BLOCK, "left"))
            part = text[low:int(places[n - 1]) + self.length]
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(self.letter[part] * self.power[:len(part)], out=total[1:])
            at = places[k:n] - low
            h = (total[at + self.length] - total[at]) * self.unpower[at]
            out[k:n] = h ^ (h >> np.uint64(31))
            k = n
        return out


_HASHES: dict[tuple[int, int], WindowHash] = {}


def _window_hash(seed: int, length: int) -> WindowHash:
    if (seed, length) not in _HASHES:
        _HASHES[seed, length] = WindowHash(seed, length)
    return _HASHES[seed, length]


def _period(length: int) -> int:
    """The longest period of which a window is longer: fewest cover places, and
    windows long enough that texts seldom share one by chance."""
    fitting = [v for v in COVERS if 2 * v <= length]
    if not fitting:
        raise ValueError(f"length must be at least {2 * min(COVERS)}")
    return max(fitting)


def _cover_places(n: int, window: int, period: int) -> np.ndarray:
    """Cover places of a text of n bytes that have a whole window ahead."""
    if n < window:
        return np.empty(0, dtype=np.int64)
    places = (np.arange(0, n - window + 1, period)[:, None] + COVERS[period][None, :]).ravel()
    return places[places <= n - window]


def _samples(window: int, period: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _window_hash(1, window)
        for b in batches:
            out, held = [], 0
            for ord_, raw in zip(b.column("ord").to_pylist(), b.column("raw")):
                text = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                places = _cover_places(len(text), window, period)
                h = hashes(text, places)
                _, at, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                first = places[at][which]  # places ascend, so this is the window's first place in the text
                later = first != places
                h[later] += places[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                first[~later] = np.where(times[which][~later] > 1, _AGAIN, _ONCE)
                out.append((h.view(np.int64), np.full(len(places), ord_), places, first))
                held += len(places)
                if held > 1 << 19:
                    yield to_batch(_SAMPLE, [np.concatenate(c) for c in zip(*out)])
                    out, held = [], 0
            if out:
                yield to_batch(_SAMPLE, [np.concatenate(c) for c in zip(*out)])

    return run


def _tied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of classes of two or more, each with the class's first member;
    a place that repeats a window of its own text with the first there."""
    for _, _, (h, ord_, pos, first) in sorted_runs(batches, ["h"], ["ord", "pos", "first"]):
        later = first >= 0
        if later.any():
            yield to_batch(_TIE, [ord_[later], pos[later], ord_[later], first[later]])
            h, ord_, pos, first = h[~later], ord_[~later], pos[~later], first[~later]
        if not len(h):
            continue
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(start, len(h)))
        head = np.repeat(start, length)
        keep = (np.repeat(length, length) > 1) | (first == _AGAIN)
        if keep.any():
            yield to_batch(_TIE, [ord_[keep], pos[keep], ord_[head][keep], pos[head][keep]])


def _stretches(ord_: int, pos: np.ndarray, to_ord: np.ndarray, to_pos: np.ndarray, window: int,
               length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, other text, shift) of stretches of ``length`` bytes or
    more that equal an earlier place: classes aligned with one text at one
    shift whose windows touch."""
    other = (to_ord != ord_) | (to_pos != pos)
    pos, to_ord, shift = pos[other], to_ord[other], (to_pos - pos)[other]
    if not len(pos):
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    order = np.lexsort((pos, shift, to_ord))
    pos, to_ord, shift = pos[order], to_ord[order], shift[order]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (to_ord[1:] != to_ord[:-1]) | (shift[1:] != shift[:-1]) | (pos[1:] - pos[:-1] > window)
    at = np.flatnonzero(new)
    start, end = pos[at], pos[np.append(at[1:], len(pos)) - 1] + window
    long = end - start >= length
    return start[long], end[long], to_ord[at][long], shift[at][long]


def _ties_of(b: pa.RecordBatch):
    """Per row: (ord, pos, to_ord, to_pos) from the batch's list columns."""
    flat = {c: list_lengths(b.column(c)) for c in ("pos", "to_ord", "to_pos")}
    values = {c: v[2].to_numpy(zero_copy_only=False) for c, v in flat.items()}
    for i, ord_ in enumerate(b.column("ord").to_pylist()):
        cut = [values[c][flat[c][0][i]:flat[c][1][i]] for c in ("pos", "to_ord", "to_pos")]
        yield ord_, *cut


def _proved(window: int, length: int):
    """Spans of proved stretches, on both sides."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ord_, pos, to_ord, to_pos in _ties_of(b):
                s, e, other, shift = _stretches(ord_, pos, to_ord, to_pos, window, length)
                out += [(np.full(len(s), ord_), s, e), (other, s + shift, e + shift)]
            if out:
                yield to_batch(_SPAN, [np.concatenate(c) for c in zip(*out)])

    return run


def _suffixes(window: int, length: int, block: int, blocks: int):
    """Suffixes of one block (a share of the hash range) with a repeated cover
    place ahead that no stretch has proved."""
    period = length - window + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _window_hash(2, length), _window_hash(3, length)
        for b in batches:
            out, held = [], 0
            for (ord_, pos, to_ord, to_pos), raw in zip(_ties_of(b), b.column("raw")):
                text = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
                n = len(text) - length + 1
                change = np.zeros(len(text) + 2, dtype=np.int32)
                np.add.at(change, np.maximum(pos - period + 1, 0), 1)
                np.add.at(change, pos + 1, -1)
                open_ = np.cumsum(change[:n]) > 0
                s, e, _, _ = _stretches(ord_, pos, to_ord, to_pos, window, length)
                change[:] = 0
                np.add.at(change, s, 1)
                np.add.at(change, e - length + 1, -1)
                places = np.flatnonzero(open_ & (np.cumsum(change[:n]) <= 0))
                h1 = first(text, places)
                mine = (h1 >> np.uint64(32)) % np.uint64(blocks) == block
                places, h1 = places[mine], h1[mine]
                if not len(places):
                    continue
                out.append((h1.view(np.int64), second(text, places).view(np.int64),
                            np.full(len(places), ord_), places))
                held += len(places)
                if held > 1 << 19:
                    yield to_batch(_SUFFIX, [np.concatenate(c) for c in zip(*out)])
                    out, held = [], 0
            if out:
                yield to_batch(_SUFFIX, [np.concatenate(c) for c in zip(*out)])

    return run


def _equal_suffixes(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, cols in sorted_runs(batches, ["h1", "h2"], ["ord", "p"]):
            keep = np.repeat(lengths > 1, lengths)
            if keep.any():
                ord_, p = cols[2][keep], cols[3][keep]
                order = np.lexsort((p, ord_))
                ord_, p = ord_[order], p[order]
                new = np.ones(len(p), dtype=bool)
                new[1:] = (ord_[1:] != ord_[:-1]) | (p[1:] - p[:-1] > length)
                at = np.flatnonzero(new)
                yield to_batch(_SPAN, [ord_[at], p[at], p[np.append(at[1:], len(p)) - 1] + length])

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text."""
    for b in batches:
        flat = {c: list_lengths(b.column(c)) for c in ("s", "e")}
        values = {c: v[2].to_numpy(zero_copy_only=False) for c, v in flat.items()}
        removed, spans, kept = [], [], []
        for i, raw in enumerate(b.column("raw").to_pylist()):
            s = values["s"][flat["s"][0][i]:flat["s"][1][i]]
            e = values["e"][flat["e"][0][i]:flat["e"][1][i]]
            order = np.argsort(s, kind="stable")
            s, reach = s[order], np.maximum.accumulate(e[order])
            new = np.ones(len(s), dtype=bool)
            new[1:] = s[1:] > reach[:-1]
            at = np.flatnonzero(new)
            begin, end = s[at].tolist(), reach[np.append(at[1:], len(s)) - 1].tolist()
            removed.append(sum(end) - sum(begin))
            spans.append(len(begin))
            kept.append([raw[x:y] for x, y in zip([0, *end], [*begin, len(raw)])])
        yield pa.RecordBatch.from_arrays(
            [b.column("k"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array([hashlib.sha256(b"".join(x)).hexdigest() for x in kept], pa.string()),
             # part by part, so that halves of two characters never join to a third
             pa.array(["".join(part.decode("utf-8", "ignore") for part in x) for x in kept], pa.string())],
            names=["k", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_texts(docs: DataFrame, text_col: str = "text", length: int = 400, blocks: int = 4) -> DataFrame:
    """(k, n_removed, n_spans, kept_sha256, kept) of every distinct text that
    loses bytes; ``k`` is the text's 128-bit key, ``kept_sha256`` the hash of
    its remaining bytes, ``kept`` the characters that are left whole.

    The suffixes are sorted in ``blocks`` blocks, one after the other; that
    bounds the shuffle files that exist at a time."""
    spark = docs.sparkSession
    period = _period(length)
    window = length - period + 1
    parts = shuffle_width(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def step(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        release_shuffles(spark)
        return out

    texts = step(  # one row a distinct text
        docs.select(text_key(text).alias("k"), text.cast("binary").alias("raw"))
        .where(F.octet_length("raw") >= length)
        .groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
        .withColumn("ord", F.monotonically_increasing_id()), "texts")
    whole = texts.where("copies > 1").select(  # each copy's strings start in the other: nothing is left
        "k", F.octet_length("raw").cast("bigint").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"),
        F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"))
    ties = step(
        texts.select("ord", "raw").mapInArrow(_samples(window, period), "h bigint, ord bigint, pos bigint, first bigint")
        .repartition(parts, "h").sortWithinPartitions("h", "ord", "pos")
        .mapInArrow(_tied, "ord bigint, pos bigint, to_ord bigint, to_pos bigint")
        .groupBy("ord").agg(*[F.collect_list(c).alias(c) for c in ("pos", "to_ord", "to_pos")]), "ties")
    tied = step(texts.join(ties, "ord"), "tied-texts")  # the later steps need no other texts
    spans = tied.select("ord", "pos", "to_ord", "to_pos") \
        .mapInArrow(_proved(window, length), "ord bigint, s bigint, e bigint")
    for block in range(blocks):
        spans = spans.unionByName(step(
            tied.select("ord", "raw", "pos", "to_ord", "to_pos")
            .mapInArrow(_suffixes(window, length, block, blocks), "h1 bigint, h2 bigint, ord bigint, p bigint")
            .repartition(parts, "h1").sortWithinPartitions("h1", "h2", "ord", "p")
            .mapInArrow(_equal_suffixes(length), "ord bigint, s bigint, e bigint"), "spans"))
    spans = spans.groupBy("ord").agg(*[F.collect_list(c).alias(c) for c in ("s", "e")])
    some = tied.where("copies = 1").select("ord", "k", "raw").join(spans, "ord").select("k", "raw", "s", "e") \
        .mapInArrow(_cut, "k binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return whole.unionByName(some)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row: a byte
    is removed if a string of ``length`` bytes that covers it also starts
    anywhere else, in this text or another.

    Edge cases: a null text is empty; texts shorter than ``length`` lose
    nothing; copies of a text (repeated rows too) of at least ``length`` bytes
    lose every byte; a null doc_id stays null; an empty table gives an empty
    result; other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = repeated_texts(docs, text_col, length).drop("kept")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("k"),
                       F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("own")) \
        .join(cut, "k", "left") \
        .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
                F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the remaining text in ``text_col``; all rows and columns
    stay. A character of which a byte is gone goes whole; a null text stays null."""
    cut = repeated_texts(docs, text_col, length).select(F.col("k").alias("row_key"), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    packed = docs.select(whole_row(docs), text_key(text).alias("row_key"))
    return packed.join(cut, "row_key", "left").select(
        [(F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col("row")[c]) if c == text_col else F.col("row")[c])
         .alias(c) for c in docs.columns])
