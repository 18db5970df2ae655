"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are word 1- and 2-grams hashed into 2**BITS slots, plus hashed buckets of a few plain
shape counts (share of letters, of repeated words, length), each weighted by its share of the text,
so that a text of any length has features of the same size. Training runs once over a bounded sample
of labelled rows (FTRL-proximal, a document an update); scoring is a sparse dot product with broadcast weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of
from .wordhash import U64, Words, mix64, ngrams, text_blocks, words_of

#: 2**BITS weights (4 bytes each) are broadcast: 1 MB.
BITS = 18
#: At most so many labelled rows are used to train, the same ones in each run (lowest hash of the id first).
TRAIN_ROWS = 20_000
#: Scale of a text's n-gram features, whose squares then sum to about 1 for a text of different words, and epochs.
SCALE, EPOCHS = 1.0, 3
_SHAPE = 64  # slots of shape features, the first ones


def features_of(words: Words, text_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, slot, value) of all texts of a block: features of text i are slot[first[i]:first[i + 1]]."""
    n = len(words.first) - 1
    counts = words.counts()
    owner = np.repeat(np.arange(n), counts)
    pairs, at = ngrams(words, 2)
    text = np.concatenate([owner, owner[at]])
    slot = np.concatenate([words.hashes, pairs ^ U64(0x5555)]) % U64((1 << BITS) - _SHAPE) + U64(_SHAPE)
    # Count equal (text, slot).
    order = np.argsort(text * (1 << BITS) + slot.astype(np.int64), kind="stable")
    combined = (text * (1 << BITS) + slot.astype(np.int64))[order]
    new = np.ones(len(combined), dtype=bool)
    new[1:] = combined[1:] != combined[:-1]
    begin = np.flatnonzero(new)
    times = np.diff(np.append(begin, len(combined)))
    text, slot = combined[begin] >> BITS, combined[begin] & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(text, weights=times.astype(float) ** 2, minlength=n))
    value = SCALE * times / norm[text]
    # Shape: each text has one slot for each of four measures.
    singles = np.bincount(text, minlength=n) / np.maximum(1, np.bincount(np.repeat(np.arange(n), counts), minlength=n) * 2 - 1)
    size = np.maximum(1, text_bytes)
    letters = np.bincount(owner, weights=(words.end - words.start).astype(float), minlength=n) / size
    measures = np.stack([np.minimum(15, np.log2(1 + counts)), np.minimum(15, 16 * np.minimum(1, singles)), np.minimum(15, 16 * letters), np.minimum(15, size / np.maximum(1, counts))], axis=1).astype(np.int64)
    shape = measures + 16 * np.arange(4)
    text = np.concatenate([text, np.repeat(np.arange(n), 4)])
    slot = np.concatenate([slot, shape.ravel()])
    value = np.concatenate([value, np.full(4 * n, 0.5)])
    order = np.argsort(text, kind="stable")
    return np.searchsorted(text[order], np.arange(n + 1)), slot[order], value[order]


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_blocks(column):
        yield a, b, *features_of(words_of(data, offsets), np.diff(offsets))


class Ftrl:
    """FTRL-proximal for logistic loss; weights are a function of z and n."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(texts: list[tuple[list, np.ndarray]], epochs: int) -> np.ndarray:
    """Weights after `epochs` passes over blocks of (vectors, labels), a vector being (slots, values)."""
    model = Ftrl(1 << BITS)
    for _ in range(epochs):
        for vectors, y in texts:
            for (slot, value), label in zip(vectors, y):
                model.update(slot, value, label)
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality", epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most `rows` labelled documents (a row of labels without text or label is left out).

    Updates are one after the other, so one task gets the sample, whose size is bounded, in the order of
    a hash of the key. Only the weights come to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    chosen = known.withColumn("turn", F.xxhash64(key)).orderBy("turn", key).limit(rows)
    joined = docs.select(key, F.lower(text_of(text)).alias("text")).join(F.broadcast(chosen), key).select("turn", "y", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b, first, slot, value in blocks_of(batch.column(2)):
                slot, value = slot.astype(np.int32), value.astype(np.float32)
                seen.append(([(slot[i:j], value[i:j]) for i, j in pairwise(first)], y[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array([fit(seen, epochs).tobytes()], pa.binary())], names=["weights"])

    row = joined.repartition(1).sortWithinPartitions("turn", "text").mapInArrow(learn, "weights binary").first()
    return np.frombuffer(row["weights"], dtype=np.float32) if row else np.zeros(1 << BITS, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", keep: bool = False, out: str = "score") -> DataFrame:
    """key (or with keep all columns of docs) and `out`, the score from 0 to 1, of each row; null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns = docs.columns if keep else [key]
    if out in columns:
        raise ValueError(f"{out} is a column of the documents: name another one for the score")
    prepared = docs.select(*columns, F.lower(text_of(text)).alias(fresh("lower text", columns)))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.zeros(0)]
            for _, _, first, slot, value in blocks_of(batch.column(batch.num_columns - 1)):
                sums.append(np.add.reduceat(shared.value[slot] * value, first[:-1]))  # every text has shape features
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*columns, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return prepared.mapInArrow(scores, f"{fields}, `{out}` double")


def held_out(key: str = "doc_id", folds: int = 5):
    """True for rows that no model learns from: crc32 of the id as text is a multiple of `folds`."""
    return F.crc32(F.col(key).cast("string")) % folds == 0


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with a score of threshold or more."""
    out = fresh("score", docs.columns)
    return score(docs, weights, key, text, True, out).where(F.col(out) >= threshold).drop(out)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted for each row of docs.

    Only labels of rows outside the held-out fold are learnt. Without labels every score is 0.5. Null
    keys are held out (they can't have labels); repeated rows get the same score.
    """
    weights = train(docs, labels.where(~held_out(key)), rows, key, text)
    scored = score(docs, weights, key, text)
    return scored.select(key, F.coalesce(held_out(key), F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
