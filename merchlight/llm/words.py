"""Words of many texts as 64-bit hashes, computed on arrays of bytes.

A word is a maximal run of bytes other than space and TAB to CR. Its hash is a
polynomial over random values of its bytes, read off two places of one running
sum, then mixed; equal words have equal hashes, and different ones share a hash
with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from merchlight.llm.common import starts_of

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (multiply and shift rounds)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << (n - 1).bit_length()))[:n]


@dataclass
class Words:
    """Words of several texts; ``first[i]:first[i + 1]`` are those of text i."""

    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    bytes: np.ndarray
    offset: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes], lower: bool, hashed: bool = True) -> Words:
    """The words of the texts; without ``hashed`` their places alone (``hash`` is empty)."""
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    offset = starts_of(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    if not raw.size:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(texts) + 1, np.int64), raw, offset)
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    if not hashed:
        return Words(np.zeros(0, U64), begin, end, np.searchsorted(begin, offset), raw, offset)
    summed = np.zeros(raw.size + 1, U64)
    np.cumsum(BYTE_VALUES[LOWER[raw] if lower else raw] * powers(BASE, raw.size), out=summed[1:])
    hashed = (summed[end] - summed[begin]) * powers(BASE_INVERSE, raw.size)[begin]
    hashed = mix(hashed + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(hashed, begin, end, np.searchsorted(begin, offset), raw, offset)


def shingles_of(words: Words, size: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and where those of each text begin.

    short: a text of fewer (but some) words gives its whole sequence as one.
    """
    counts = words.counts()
    made = np.maximum(counts - size + 1, 0)
    n = max(0, len(words.hash) - size + 1)
    rolled = np.zeros(n, U64)
    for k in range(size):
        rolled = rolled * U64(0x9FB21C651E98DF25) + words.hash[k:k + n]
    rolled = mix(rolled + U64(size))
    index = np.arange(n)
    owner_end = np.repeat(words.first[1:], counts)[:n]
    kept = rolled[index + size <= owner_end]
    first = starts_of(made)
    few = np.flatnonzero((counts > 0) & (counts < size)) if short else []
    if len(few):
        extra = []
        for i in few:
            h = U64(0)
            for w in words.hash[words.first[i]:words.first[i + 1]]:
                h = U64((int(h) * 0x9FB21C651E98DF25 + int(w)) & (2**64 - 1))
            extra.append(mix(np.array([h + U64(counts[i])], U64))[0])
        kept = np.insert(kept, first[few], np.array(extra, U64))
        made[few] = 1
        first = starts_of(made)
    return kept, first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and where each text's begin."""
    parts, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(sizes)):
        part = np.sort(values[first[i]:first[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i] = len(part)
    return (np.concatenate(parts) if parts else values[:0]), starts_of(sizes)
