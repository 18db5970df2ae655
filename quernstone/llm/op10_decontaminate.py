"""Benchmark decontamination: rare words as seeds, a bound on the score, Smith-Waterman alignment.

The test items are the stated query set: they are taken in blocks of bounded size, each broadcast
and held against all documents where they lie, so no text is shuffled. No step loses a copy. At a score of min_score at
least `need` of an item's L words are matched, so at least k of any L - need + k of them: of each item, that many words found in the
fewest documents of the corpus are its seeds (counted over all documents), and a document with k of them is looked at. Each matched
word adds MATCH at most and every other word between costs something, which bounds the score of each stretch of
the document; only stretches whose bound reaches min_score are aligned, word by word, with the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .wordhash import U64, WORD, Words, text_blocks, words_of

#: Items of fewer words mark nothing: a common word or two would mark every document.
LEAST_WORDS = 5
#: Seeds of an item that a document must hold (all that an item needs, if fewer).
SEEDS = 4
#: Bytes of item texts in a block, which the driver holds and broadcasts (a longer item is a block of its own).
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.0
MISS = max(MISMATCH, GAP)
#: (document, item) pairs of seeds that are counted at once.
_PAIRS = 1 << 22


@dataclass
class Items:
    """The items of a block as numbers of words; word number k has seeds item[first[k] : first[k + 1]], each `times` times."""

    ids: list
    hashes: np.ndarray
    words: list[np.ndarray]
    need: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word of a block of texts; len(hashes) for words of no item."""
        if not len(self.hashes):
            return np.zeros(len(words.hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hashes, at, len(self.hashes))


def items_of(rows: list[tuple], min_score: float) -> Items:
    """rows: (id, lower-cased text). All words are seeds."""
    words = []
    for _, text in rows:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        words.append(words_of(data, np.array([0, len(data)])).hashes)
    hashes, number = np.unique(np.concatenate([np.zeros(0, dtype=U64), *words]), return_inverse=True)
    words = np.split(number, np.cumsum([len(w) for w in words]))[:-1]
    need = np.array([max(1, int(np.ceil(min_score * len(w) - 1e-9))) for w in words], dtype=np.int64)
    return _seeded(Items([r[0] for r in rows], hashes, words, need, *[np.zeros(0, np.int64)] * 3), words)


def _seeded(items: Items, seeds: list[np.ndarray]) -> Items:
    """items with these words of each as its seeds."""
    pairs, times = np.unique(np.concatenate([np.zeros(0, np.int64), *(x * len(seeds) + i for i, x in enumerate(seeds))]), return_counts=True)
    number, item = np.divmod(pairs, max(1, len(seeds)))
    return replace(items, first=np.searchsorted(number, np.arange(len(items.hashes) + 1)), item=item, times=times)


def rare_seeds(items: Items, df: np.ndarray) -> Items:
    """The items with as seeds only the rarest words of each, so many that no copy can do without SEEDS of them."""
    seeds = []
    for words, need in zip(items.words, items.need):
        order = np.argsort(df[words], kind="stable")
        seeds.append(words[order[: len(words) - need + min(SEEDS, need)]])
    return _seeded(items, seeds)


def local_alignment(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Best Smith-Waterman score of two word sequences, and where in the window it ends."""
    row = np.zeros(len(window) + 1)
    steps = GAP * np.arange(len(window) + 1)
    best, end = 0.0, 0
    for word in item:
        diagonal = row[:-1] + np.where(window == word, MATCH, MISMATCH)
        row[1:] = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        row = np.maximum.accumulate(row - steps) + steps  # gaps in the item: a running maximum
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def windows(hits: np.ndarray, text: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of stretches that can hold an alignment of score `least`, in words of texts laid one after the other.

    hits: the places of words that are in the item; text: the text of each. A hit adds at most MATCH, any other word costs at least
    MISS. An alignment with no part below zero lies between two places where this sum reaches a new minimum.
    """
    if not len(hits):
        return
    before = (MATCH - MISS) * np.arange(len(hits)) + MISS * hits
    before -= text * (before.max() - before.min() + 1)  # each text begins with a new minimum
    lowest = np.minimum.accumulate(before)
    first = np.flatnonzero(np.concatenate([[True], lowest[1:] < lowest[:-1]]))
    last = np.concatenate([first[1:], [len(hits)]]) - 1
    for i in np.flatnonzero(np.maximum.reduceat(before + MATCH - lowest, first) >= least - 1e-9):
        yield int(text[first[i]]), int(hits[first[i]]), int(hits[last[i]]) + 1


def _pairs(text: np.ndarray, number: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of all pairs with enough seeds, by item; text, number: the words of texts, in order of the texts."""
    own = np.unique(text * len(items.hashes) + number)
    text, number = np.divmod(own, max(1, len(items.hashes)))
    times = items.first[number + 1] - items.first[number]
    ends = np.cumsum(times)
    found, a = [np.zeros(0, np.int64)], 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - times[a] + _PAIRS, side="right")))
        if b < len(text):  # a text is never cut
            b = int(np.searchsorted(text, text[b])) if text[b] > text[a] else int(np.searchsorted(text, text[a], side="right"))
        t = times[a:b]
        which = np.repeat(items.first[number[a:b]] - (ends[a:b] - t - ends[a] + times[a]), t) + np.arange(t.sum())
        pairs, at = np.unique(np.repeat(text[a:b], t) * len(items.ids) + items.item[which], return_inverse=True)
        seeds = np.bincount(at, weights=items.times[which], minlength=len(pairs))
        found.append(pairs[seeds >= np.minimum(items.need, SEEDS)[pairs % len(items.ids)]])
        a = b
    text, item = np.divmod(np.concatenate(found), max(1, len(items.ids)))
    order = np.argsort(item, kind="stable")
    return text[order], item[order]


def document_frequencies(lower: DataFrame, items: Items) -> np.ndarray:
    """In how many rows of lower (key, text) each word of the items occurs."""
    shared = lower.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        size = len(items.hashes)
        totals = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(1)):
                words = words_of(data, offsets)
                number = items.numbers(words)
                at = np.flatnonzero(number < size)
                totals += np.bincount(np.unique((np.searchsorted(words.first, at, side="right") - 1) * size + number[at]) % size, minlength=size)
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(totals[there], pa.int64())], names=["word", "n"])

    df = np.zeros(len(items.hashes), dtype=np.int64)
    for r in lower.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[r["word"]] = r["n"]
    return df


def _aligned(lower: DataFrame, items: Items, min_score: float, item_type: str) -> DataFrame:
    shared = lower.sparkSession.sparkContext.broadcast(items)
    key_type = lower.schema[0].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        mark = np.zeros(len(items.hashes) + 1, dtype=bool)
        for batch in batches:
            rows, found = [], []
            for a, _, data, offsets in text_blocks(batch.column(1)):
                words = words_of(data, offsets)
                number = items.numbers(words)
                at = np.flatnonzero(number < len(items.hashes))
                text, item = _pairs(np.searchsorted(words.first, at, side="right") - 1, number[at], items)
                new, counts = np.flatnonzero(np.diff(item, prepend=-1)), words.counts()
                for b, e in zip(new, [*new[1:], len(text)]):
                    target, own = items.words[item[b]], text[b:e]
                    sizes = counts[own]
                    starts = np.cumsum(sizes) - sizes
                    laid = number[np.repeat(words.first[own] - starts, sizes) + np.arange(sizes.sum())]
                    mark[target] = True
                    hits = np.flatnonzero(mark[laid])
                    mark[target] = False
                    best: dict[int, tuple[float, int]] = {}
                    for t, w0, w1 in windows(hits, np.searchsorted(starts, hits, side="right") - 1, min_score * MATCH * len(target)):
                        score, end = local_alignment(target, laid[w0:w1])
                        best[t] = max(best.get(t, (0.0, 0)), (score, int(starts[t]) - w0 - end))
                    for t, (score, end) in best.items():
                        if score >= min_score * MATCH * len(target):
                            rows.append(a + int(own[t]))
                            found.append((items.ids[item[b]], score / (MATCH * len(target)), -end))
            ids, scores, ends = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, item_arrow), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], names=["doc", "item", "score", "end_word"])

    item_arrow = pa.int64() if item_type in ("bigint", "int") else pa.string()
    return lower.mapInArrow(align, f"doc {key_type}, item {'long' if item_arrow == pa.int64() else 'string'}, score double, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, score, end_word: a row for each document and item of which it holds a copy, whole or edited.

    score is the best local alignment of the words (case and punctuation aside) over that of a full
    copy, min_score to 1, and every pair at min_score has its row, but for items of fewer than LEAST_WORDS words, which have none; end_word is the word of the document after which it ends. Null or empty texts match nothing;
    rows that are repeated give repeated pairs. No rows on either side give no rows.
    """
    lower = docs.select(key, F.lower(text_of(text)).alias("lower text"))
    items = benchmark.select(F.col(item).alias("id"), F.lower(text_of(item_text)).alias("lower text"))
    items = items.where(F.regexp_count("lower text", F.lit(WORD)) >= LEAST_WORDS)
    item_type = items.schema["id"].dataType.simpleString()
    total = items.agg(F.sum(F.octet_length("lower text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    result = None
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "lower text"), F.lit(blocks)) == i).orderBy("id", "lower text")
        held = items_of([(r[0], r[1]) for r in block.collect()], min_score)  # about BLOCK_BYTES
        if len(held.hashes):
            held = rare_seeds(held, document_frequencies(lower, held))
        found = _aligned(lower, held, min_score, item_type)
        result = found if result is None else result.unionByName(found)
    return result.select(F.col("doc").alias(key), F.col("item").alias(item), "score", "end_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_score: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose key has no copy of a test item."""
    found = contaminated(docs, benchmark, min_score, key, text).select(F.col(key).alias("bad key")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["bad key"]), "left_anti")
