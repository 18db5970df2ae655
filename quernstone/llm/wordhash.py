"""Words of Arrow string columns as arrays of 64-bit hashes, without a Python loop over words.

A word is a longest run of ASCII letters, digits and bytes of non-ASCII characters; everything
else separates words. Callers lower-case the text before (F.lower), so hashes ignore case.
The hash of a word is a polynomial in its bytes modulo 2**64, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
#: The same words as a pattern.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Bytes handled at once. A longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(n, base, dtype=U64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=U64))
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Hashes of all words of a block of texts; `first[i]:first[i + 1]` are those of text i."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: bytes of all texts, one after the other; offsets: where each begins, and the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U64), np.zeros(len(offsets), dtype=np.int64), none, none, data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    power, inverse = powers(max(n, BLOCK_BYTES))
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashes = mix64((sums[end] - sums[start]) * inverse[start])
    return Words(hashes, np.searchsorted(start, offsets).astype(np.int64), start, end, data)


def text_blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of at most block_bytes, or one row. Null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + block_bytes, side="right")) - 1)
        yield at, to, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and the number of each run's first word."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    grams = np.zeros(total - n + 1, dtype=U64)
    for i in range(n):
        grams = grams * U64(0xD6E8FEB86659FD93) + words.hashes[i : total - n + 1 + i]
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    at = np.flatnonzero(text[: total - n + 1] == text[n - 1 :])
    return mix64(grams[at]), at
