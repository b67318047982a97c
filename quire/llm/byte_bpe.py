"""Byte-level BPE: pre-tokenisation without regular expressions, cached pair
merging, decoding with offsets.

The splitting pattern is a small automaton over classes of code points. Every
code point becomes a class (one table look-up; what the pattern looks ahead
for is folded into the class), every class a transition function over the
automaton's states. Function composition is associative, so the state before
every code point follows from a blocked prefix scan over whole arrays.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import RecentCache, doc_texts

# classes of code points: letter, number, other, apostrophe that may start a contraction with one or
# two letters, space before a non-space, white space inside or at the end of a run's first part,
# other white space before a non-space
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, BREAK = range(8)
# states: a token must start here, inside a run of letters, numbers, others; after a leading space;
# inside white space; one or two letters of a contraction to come
START, IN_LETTER, IN_NUMBER, IN_OTHER, LED, IN_BLANK, ONE, TWO = range(8)
_SCAN = 256            # width of a scan block
_CHARS = 1 << 21       # code points scanned together
_CACHED = 600_000
_SHORT = 64

# fixed values: the code points of the White_Space property
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Base class of every code point: LETTER, NUMBER, OTHER or BLANK."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                        np.uint8, sys.maxunicode + 1)
    table[_WHITE] = BLANK
    return table


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(state after, does a token start at this code point)."""
    if kind == LETTER:
        if state in (ONE, TWO):
            return (START if state == ONE else ONE), False
        return IN_LETTER, state not in (IN_LETTER, LED)
    if kind == NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, LED)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, LED):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: ONE, LONG: TWO}[kind], True
    if kind == SPACE:
        return LED, True
    if kind == BLANK:
        return IN_BLANK, state != IN_BLANK
    return IN_BLANK, True  # BREAK


@lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(function of each class, then of each class at a text's start;
    composition table; value table; token starts by state and class)."""
    n = 8
    base = [tuple(_step(s, k)[0] for s in range(n)) for k in range(n)]
    base += [(f[START],) * n for f in base]  # a text's first code point forgets what came before
    functions = list(dict.fromkeys(base))
    known = {f: i for i, f in enumerate(functions)}
    at = 0
    while at < len(functions):  # close under composition with the generators
        for g in base:
            h = tuple(g[x] for x in functions[at])
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
        at += 1
    compose = np.array([[known[tuple(g[x] for x in f)] for g in functions] for f in functions], dtype=np.uint16)
    value = np.array(functions, dtype=np.uint8)
    starts = np.array([[_step(s, k)[1] for k in range(n)] for s in range(n)])
    return np.array([known[f] for f in base], dtype=np.uint16), compose, value, starts


def _scan(f: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of an array of functions."""
    n = len(f)
    if n <= _SCAN:
        out = f.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    whole = n // _SCAN * _SCAN
    block = np.ascontiguousarray(f[:whole].reshape(-1, _SCAN).T)
    for j in range(1, _SCAN):
        block[j] = compose[block[j - 1], block[j]]
    total = _scan(block[-1], compose)
    block[:, 1:] = compose[total[:-1], block[:, 1:]]
    out = np.empty(n, f.dtype)
    out[:whole] = block.T.ravel()
    if whole < n:
        rest = _scan(f[whole:], compose)
        out[whole:] = compose[total[-1], rest]
    return out


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a token. ``points`` are the code points of
    texts laid end to end, ``first`` marks each text's first one."""
    n = len(points)
    kind = class_table()[points]
    end = np.ones(n, dtype=bool)   # the text's last code point
    end[:-1] = first[1:]
    white = kind == BLANK
    solid_next = np.zeros(n, dtype=bool)
    solid_next[:-1] = ~white[1:] & ~end[:-1]
    kind[white & solid_next] = BREAK
    kind[solid_next & (points == 32)] = SPACE
    at = np.flatnonzero(points == 39)
    if len(at):
        ahead = [np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)]
        ok = ~end[at]
        ahead[0][ok] = points[at[ok] + 1]
        ok[ok] = ~end[at[ok] + 1]
        ahead[1][ok] = points[at[ok] + 2]
        kind[at[np.isin(ahead[0], [ord(c) for c in "stmd"])]] = SHORT
        for a, b in ("re", "ve", "ll"):
            kind[at[(ahead[0] == ord(a)) & (ahead[1] == ord(b))]] = LONG
    generators, compose, value, starts = transitions()
    after = value[_scan(generators[kind + 8 * first], compose), START]
    before = np.empty(n, np.uint8)
    before[1:] = after[:-1]
    before[first] = START
    return starts[before, kind]


def pretokens(texts: list[str]) -> list[list[str]]:
    """The pattern's matches in each text, in order; together they are the text."""
    out: list[list[str]] = []
    group: list[str] = []
    size = 0

    def flush() -> None:
        joined = "".join(group)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        begin = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), dtype=bool)
        first[begin[lengths > 0]] = True
        at = np.flatnonzero(token_starts(points, first)) if len(points) else np.empty(0, np.int64)
        cuts = np.searchsorted(at, np.append(begin, len(points)))
        ends = np.append(at[1:], len(points)).tolist()
        pieces = [joined[a:b] for a, b in zip(at.tolist(), ends)]
        out.extend(pieces[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= _CHARS:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.cache = RecentCache(_CACHED)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank merges first,
        the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > _SHORT:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pair = [ranks.get(piece[i:i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            pair.pop(i)
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked parts, n log n for any length."""
        ranks, n = self.ranks, len(piece)
        end, following, previous = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = following[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two has merged since
            alive[j] = 0
            end[i], following[i] = stop, following[j]
            if following[j] < n:
                previous[following[j]] = i
            if following[i] < n:
                stop = end[following[i]]
                if (r := ranks.get(piece[i:stop])) is not None:
                    heapq.heappush(heap, (r, i, stop))
            p = previous[i]
            if p >= 0 and (r := ranks.get(piece[p:end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = following[i]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for k, n in _groups(texts):
            split = pretokens(texts[k:n])
            known, missing = self.cache.lookup(set().union(*split))
            if missing:
                new = {p: np.array(self.merge(p.encode()), dtype="<u4").tobytes() for p in missing}
                self.cache.add({p: v for p, v in new.items() if len(p) <= _SHORT})
                known |= new
            out += [np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4") for pieces in split]
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes, offsets): token i is bytes[offsets[i]:offsets[i + 1]]."""
        parts = list(map(self.token.__getitem__, ids.tolist()))
        return b"".join(parts), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a million characters."""
    k = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= 1 << 20:
            yield k, i + 1
            k, size = i + 1, 0
    if k < len(texts):
        yield k, len(texts)


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One codec a Python worker and file."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text",
                     digests: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, offsets array<bigint>) of every row: the ids
    of the whole text and where each token's bytes start and the last ends.
    With ``digests`` instead (doc_id, n_tokens, ids_sha256, decoded_sha256):
    hashes of the ids (little-endian unsigned 32 bits) and of the bytes that
    decoding the ids gives.

    Edge cases: a null or empty text has no tokens; repeated rows stay
    repeated; a null doc_id stays null; one very long text is handled whole;
    an empty table gives an empty result; other columns are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids_of = bpe.encode(texts)
            if digests:
                cols = [pa.array([len(i) for i in ids_of], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids_of], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(i)[0]).hexdigest() for i in ids_of], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array([i.astype(np.int32) for i in ids_of], pa.list_(pa.int32())),
                        pa.array([bpe.decode(i)[1] for i in ids_of], pa.list_(pa.int64()))]
                names = ["ids", "offsets"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *names])

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests \
        else "ids array<int>, offsets array<bigint>"
    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, " + schema)


def decode_documents(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the texts of (doc_id, ids); null ids give null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.array(x, dtype="<u4"))[0].decode("utf-8", "replace")
                     for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"),
                          F.col(ids_col).cast("array<int>").alias("ids")) \
        .mapInArrow(run, "doc_id bigint, text string")
