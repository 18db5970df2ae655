"""Fill-in-the-middle: texts are cut in two places between units and the parts are told in another order.

Where a unit (a line, a word, a character) begins is a predicate on two adjacent bytes, so it can be
asked anywhere in a text. Texts are cut into chunks, each of which also sees the last byte of the one
before; the beginnings in each chunk are counted, all chunks of a block of texts at once. Prefix sums of the counts
tell how many units a text has and which chunk holds the unit of either cut; only these two chunks are scanned again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .wordhash import text_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk.
CHUNK = 4096
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

#: Whether a unit begins at a byte, given the byte before it and itself.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda before, here: before == 10,
    # With the blanks after it; those in front of the first word are a unit.
    "word": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "char": lambda before, here: (here & 0xC0) != 0x80,
}


@dataclass
class Chunks:
    """Chunks of a block of texts: where each begins, the units that begin in it, and their prefix sums."""

    data: np.ndarray
    ends: np.ndarray  # texts: where each begins, and the end
    first: np.ndarray  # texts: number of the first chunk, and the number of chunks
    start: np.ndarray  # chunks: first byte, and the end
    before: np.ndarray  # units that begin before each chunk, and in all
    begins: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def units(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before[self.first])

    def position(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Byte within the block at which unit number `rank` of each text begins (its end for the rank after the last)."""
        total = self.before[self.first[text]] + rank
        chunk = np.searchsorted(self.before, total, side="right") - 1
        at = self.ends[text + 1].copy()
        for i in np.flatnonzero(rank < self.units()[text]):
            c = chunk[i]
            found = np.flatnonzero(_begins(self.data, self.start[c], self.start[c + 1], self.begins, c == self.first[text[i]]))
            at[i] = self.start[c] + found[total[i] - self.before[c]]
        return at


def _begins(data: np.ndarray, a: int, b: int, begins: Callable, first: bool) -> np.ndarray:
    """Whether a unit begins at each byte from a to b, which a text's first chunk does at its first byte."""
    there = begins(data[max(a - 1, 0) : b - 1], data[max(a, 1) : b])
    if a == 0:
        there = np.append(True, there)
    if first:
        there[0] = True
    return there


def chunks_of(data: np.ndarray, ends: np.ndarray, unit: str, size: int = CHUNK) -> Chunks:
    """data: bytes of all texts, one after the other; ends: where each begins, and the end."""
    sizes = -(-np.diff(ends) // size)  # an empty text has no chunk
    first = np.append(0, np.cumsum(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.append(ends[owner] + (np.arange(first[-1]) - first[owner]) * size, ends[-1:])
    counts = np.zeros(first[-1], dtype=np.int64)
    if first[-1]:
        there = _begins(data, 0, len(data), UNITS[unit], True)
        there[start[first[:-1][sizes > 0]]] = True
        counts = np.add.reduceat(there, start[:-1], dtype=np.int64)
    return Chunks(data, ends, first, start, np.append(0, np.cumsum(counts)), UNITS[unit])


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, unit: str = "line", key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output for each row of docs, whatever its other columns.

    n is the number of units. Four numbers from the SHA-256 of seed, a colon and the key decide the two cuts (each of
    the n + 1 places alike, so parts may be empty), whether the text is transformed (rate in 100) and in which order: `psm` has
    prefix, suffix, middle, `spm` (in 100 of those transformed) suffix, prefix, middle, each after its mark. A text that
    is empty or holds a mark stays as it is (`plain`, no part sizes); so `restored` always gives the text back. Null texts
    count as empty; a null key is drawn for as an empty one; rows that repeat a key and a text get the same result.
    An empty table gives an empty one.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    slim = docs.select(F.col(key).alias("k"), draws.alias("h"), text_of(text).alias("t"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(1).flatten()).reshape(-1, 4)
            for a, b, data, ends in text_blocks(batch.column(2)):
                held = chunks_of(data, ends, unit, chunk)
                n, raw, own = held.units(), data.tobytes(), h[a:b]
                cuts = np.sort(own[:, :2] % (n[:, None] + 1), axis=1)
                texts = np.arange(b - a)
                low, high = held.position(texts, cuts[:, 0]), held.position(texts, cuts[:, 1])
                forms, sizes, outputs = [], [], []
                for i in range(b - a):
                    whole = raw[ends[i] : ends[i + 1]]
                    if not whole or own[i, 2] % 100 >= rate or any(m in whole for m in marks):
                        forms.append("plain")
                        sizes.append((None, None))
                        outputs.append(whole)
                        continue
                    parts = raw[ends[i] : low[i]], raw[high[i] : ends[i + 1]], raw[low[i] : high[i]]
                    p, s, m = map(bytes.__add__, marks, parts)
                    forms.append("spm" if own[i, 3] % 100 < spm else "psm")
                    sizes.append((_chars(data[ends[i] : low[i]]), _chars(data[low[i] : high[i]])))
                    outputs.append(s + p + m if forms[-1] == "spm" else p + s + m)
                prefix, middle = zip(*sizes)
                columns = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = slim.mapInArrow(transform, f"k {slim.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("k").alias(key), *out.columns[1:])


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text of an output of fill_in_middle: its parts, which hold no mark, in their first order."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = F.when(form == "psm", F.array(*[F.lit(i) for i in (1, 3, 2)])).otherwise(F.array(*[F.lit(i) for i in (2, 3, 1)]))
    return F.when(form == "plain", output).otherwise(F.concat_ws("", F.transform(order, lambda i: F.get(parts, i))))
