"""Word hashes, shingles and MinHash for whole batches of texts, in numpy.

Texts are compared after bringing characters to one form, dropping accents (d
with stroke as d), lower-casing and keeping only runs of a-z and 0-9 as words.
A batch is one array of code points; a table turns it into bytes; words are
hashed by segment sums. Nothing here loops over words or shingles in Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from noteweave.llm.canon import canonical

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    table = np.full(0x10000, 32, np.uint8)
    for o in range(0x10000):
        if 0xD800 <= o < 0xE000:
            continue
        d = unicodedata.normalize("NFD", chr(o).lower().replace("đ", "d"))[:1]
        if d.isascii() and d.isalnum():
            table[o] = ord(d)
    return table


FOLD = _fold_table()
_rng = np.random.default_rng(20240501)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_POWER = np.cumprod(np.concatenate([[U(1)], np.full(4095, U(0x100000001B3))]))
_PERM = _rng.integers(1, 2**32, 4096, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(1, 2**32, 4096, dtype=np.uint64).astype(np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """A finisher that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@dataclass
class Words:
    """The words of a batch of texts: a hash each, and where each text begins (one more at the end)."""

    hashes: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def fingerprints(self) -> np.ndarray:
        """A 64-bit hash of each text's sequence of words; 0 for a text without words."""
        n = self.counts()
        if not len(self.hashes):
            return np.zeros(len(n), np.int64)
        place = np.arange(len(self.hashes), dtype=np.uint64) - np.repeat(self.offsets[:-1], n).astype(np.uint64)
        return np.where(n > 0, _sums(mix(self.hashes ^ (place * GOLDEN)), self.offsets), U(0)).view(np.int64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of ``k`` words within a text, and the text's number."""
        m = len(self.hashes) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.offsets) - 1), self.counts())
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = h * U(0xD6E8FEB86659FD93) + self.hashes[i : i + m]
        keep = doc[:m] == doc[k - 1 :]
        return mix(h[keep]), doc[:m][keep]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[U(0)], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(texts: Sequence[str]) -> Words:
    """The words of a batch. Whole texts of any length; an empty one has none."""
    texts = [canonical(t) for t in texts]
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = FOLD[np.where(codes < 0x10000, codes, 0)]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = flat != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(begin), np.int64))
    at = np.flatnonzero(inside)
    word_at = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.append(word_at, len(at))))
    h = np.add.reduceat(_LETTER[flat[at]] * _POWER[place & 4095], word_at)
    return Words(mix(h), np.searchsorted(starts, begin))


def minhash(w: Words, k: int, size: int, step: int = 1 << 7) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures (one row per text with at least ``k`` words) and those texts' numbers.

    Works on ``step`` shingles of a text at a time, in two buffers that are made
    once and small enough for a core's own cache: the passes over them are most of
    the cost of a signature. Memory is bounded however long a text is.
    """
    h, doc = w.windows(k)
    ids, first = np.unique(doc, return_index=True)
    out = np.full((len(ids), size), 0xFFFFFFFF, np.uint32)
    low = (h >> U(32)).astype(np.uint32)[:, None]
    values, shifted = np.empty((2, step, size), np.uint32)
    xor, perm = _XOR[:size], _PERM[:size]
    for least, begin, end in zip(out, first.tolist(), [*first[1:].tolist(), len(low)], strict=False):
        for a in range(begin, end, step):
            part = low[a : min(a + step, end)]
            v, s = values[: len(part)], shifted[: len(part)]
            np.bitwise_xor(part, xor, out=v)
            np.multiply(v, perm, out=v)
            np.right_shift(v, np.uint32(15), out=s)
            np.bitwise_xor(v, s, out=v)
            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
            np.minimum(least, v.min(axis=0), out=least)
    return out, ids


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 48-bit key for each text and band; equal keys mean equal rows of equal bands."""
    s = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)[None, :] * GOLDEN
    for i in range(rows):
        h = mix(h + s[:, :, i])
    return (h >> U(16)).view(np.int64)
