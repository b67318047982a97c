"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library,
through a compact cache of the pieces they are made of."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

_GROUP = 1 << 19      # characters of text handled together
_PIECES = 3_000_000   # pieces kept by a Python worker
_IDS = 1 << 24        # ids kept for them
_RECENT = 1 << 16
# Latin letters, then ASCII punctuation without apostrophes: a word and a run of others for the tokenizer
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


_GAP, _LETTER, _SIGN, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """Of each byte: a gap between pieces, an ASCII letter, an ASCII sign
    other than the apostrophe, or anything else."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    for c in range(33, 127):
        if chr(c).isalpha():
            out[c] = _LETTER
        elif not chr(c).isdigit() and c != 39:
            out[c] = _SIGN
    out[[32, 10]] = _GAP
    return out


_KIND = _kinds()


class PieceHash:
    """64-bit polynomial hashes of slices of a byte array."""

    def __init__(self, size: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.letter = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        self.power, self.unpower = (self._powers(x, size) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letter[data] * self.power[:len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.unpower[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9E3779B97F4A7C15)


class PieceEncoder:
    """Encodes texts to ids with the same result as ``Tokenizer.encode`` on
    the whole text without special tokens.

    The tokenizer lower-cases, drops white space, splits letters from signs
    and merges across neither. So the pieces between spaces and line ends,
    also cut between an ASCII letter and an ASCII sign other than the
    apostrophe (which may start a contraction), can be encoded one by one.
    Pieces are found and hashed on byte arrays; a sorted array of hashes leads
    to the ids of those seen before. New words are encoded together in one
    call, each ending at the token that closes a word; other new pieces on
    their own. The cache is emptied when full, which bounds memory."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.largest = max(vocabulary.values())
        size = self.largest + 1
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.closes = np.zeros(size, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.hash = PieceHash(4 * _GROUP + 1)
        self._reset()

    def _reset(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.old, self.recent = none, none       # sorted hashes, first id, number of ids
        self.pool, self.used = np.empty(1 << 16, self.kind), 0

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        if not pieces:
            return []
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.kind) for e in found]

    def _encode_words(self, words: list[str]) -> list[np.ndarray]:
        if not words:
            return []
        whole = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ids = np.array(whole, dtype=self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._encode(words)
        stops = ends.tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def _ids_of(self, pieces: list[str]) -> list[np.ndarray]:
        simple = [_SIMPLE(p) for p in pieces]
        parts = [None if m is None else (m[1].lower(), m[2]) for m in simple]
        words = list({w for p in parts if p is not None for w in p if w})
        known = dict(zip(words, self._encode_words(words)))
        other = iter(self._encode([p for p, m in zip(pieces, parts) if m is None]))
        return [next(other) if m is None else
                known[m[0]] if not m[1] else np.concatenate([known[m[0]], known[m[1]]]) for m in parts]

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        key = np.concatenate([a[0], b[0]])
        order = np.argsort(key, kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))

    def _look_up(self, key: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fill first and size of the known keys; returns which are unknown."""
        unknown = np.ones(len(key), dtype=bool)
        for keys, firsts, sizes in (self.old, self.recent):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                first[hit], size[hit] = firsts[at[hit]], sizes[at[hit]]
                unknown &= ~hit
        return unknown

    def _learn(self, key: np.ndarray, pieces: list[str]) -> None:
        ids = self._ids_of(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.empty(0, self.kind)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        first = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.recent = self._merge(self.recent, (key, first, size))
        if len(self.recent[0]) > _RECENT:
            self.old, self.recent = self._merge(self.old, self.recent), tuple(x[:0] for x in self.recent)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            if size + len(t) > _GROUP and group:
                out += self._group(group)
                group, size = [], 0
            if len(t) > _GROUP:
                out.append(b"".join(self._group([part])[0] for part in _cut(t)))
                continue
            group.append(t)
            size += len(t)
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        joined = b"\n".join(raw)
        if len(joined) >= len(self.hash.power):  # one piece of extreme length
            return [ids.astype("<u4").tobytes() for ids in self._encode(texts)]
        plain = b"<|" not in joined  # no special token that a split or lower case could break or make
        if plain:
            joined = joined.lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        kind = np.zeros(len(data) + 2, dtype=np.uint8)
        kind[1:-1] = _KIND[data]
        edge = kind[:-1] != kind[1:]
        if not plain:
            edge &= (kind[:-1] == _GAP) | (kind[1:] == _GAP)
        else:
            edge &= (kind[:-1] != _OTHER) & (kind[1:] != _OTHER) | (kind[:-1] == _GAP) | (kind[1:] == _GAP)
        start = np.flatnonzero(edge & (kind[1:] != _GAP))
        end = np.flatnonzero(edge & (kind[:-1] != _GAP))
        if self.used > _IDS or len(self.old[0]) > _PIECES:
            self._reset()
        key, at, which = np.unique(self.hash(data, start, end), return_index=True, return_inverse=True)
        first, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        unknown = np.flatnonzero(self._look_up(key, first, size))
        if len(unknown):
            rows = at[unknown]
            self._learn(key[unknown], [joined[a:b].decode() for a, b in zip(start[rows].tolist(), end[rows].tolist())])
            self._look_up(key, first, size)
        first, size = first[which], size[which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(first - total[:-1], size) + np.arange(total[-1])].astype("<u4").tobytes()
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        cut = (4 * total[np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))]).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _cut(text: str) -> list[str]:
    """Parts of at most ``_GROUP`` characters where spaces allow it."""
    out, at = [], 0
    while len(text) - at > _GROUP:
        stop = text.rfind(" ", at, at + _GROUP)
        if stop <= at:
            stop = text.find(" ", at + _GROUP)
            if stop < 0:
                break
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker and file."""
    return PieceEncoder(path)
