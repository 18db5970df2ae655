"""Names by sequence labelling: an averaged structured perceptron over the words of a text, decoded by Viterbi.

A word's tag is O, B-<label> or I-<label>. Features of a word and its neighbours are hashed to 2**bits rows of weights, so
the model has a fixed size whatever it learns from, and may be broadcast. Learning mixes parameters: in each epoch every shard of the
rows starts from the same weights, and their changes are averaged. Texts are decoded many at a time: a shard decodes as many as it expects to get right with
the weights at hand and goes on from the first that is wrong, which is the same as one after the other. Decoding is map only and takes whole texts, in time linear in their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .entities import description

#: Rows of weights (as a power of two), epochs, shards that learn side by side, labels at most.
BITS, EPOCHS, SHARDS, MOST_LABELS = 16, 5, 8, 50
_WORD = re.compile(r"\w+|[^\w\s]")
_SPANS = "array<struct<start:int,end:int,label:string>>"
_FOUND = "array<struct<start:int,end:int,text:string,label:string>>"
_KINDS = 10
#: Words (with padding) that are decoded at once, and texts at most that a shard decodes ahead.
AT_ONCE, AHEAD = 100_000, 256


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    """Classes of the word's characters, runs as one: NATION_12 is X_d."""
    classes = ["X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word]
    return "".join(c for i, c in enumerate(classes) if not i or c != classes[i - 1])


@lru_cache(1 << 18)
def _slot(feature: str, bits: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << bits) - 1)


def words(text: str) -> list[tuple[int, int]]:
    """(start, end) of each word or sign."""
    return [m.span() for m in _WORD.finditer(text)]


@lru_cache(1 << 17)
def _seen(before: str, word: str, after: str, bits: int) -> tuple[int, ...]:
    """Slots of a word between two others; an empty one is the edge of the text."""
    left, own, right, shape = before.lower(), word.lower(), after.lower(), _shape(word)
    seen = ("1", f"w{own}", f"s{shape}", f"p{own[:3]}", f"e{own[-3:]}", f"v{left}", f"n{right}", f"t{_shape(before)}", f"u{_shape(after)}", f"x{left} {shape}")
    return tuple(_slot(f, bits) for f in seen)


def slots(tokens: list[str], bits: int = BITS) -> np.ndarray:
    """A row for each token with the slots of its features."""
    rows = [_seen(x, y, z, bits) for x, y, z in zip(["", *tokens], tokens, [*tokens[1:], ""])]
    return np.array(rows, np.int32).reshape(len(tokens), _KINDS)


def tags_of(labels: list[str]) -> list[str]:
    return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]


def forbidden(n: int) -> np.ndarray:
    """For tags before (the last row: the start) and after: an I- tag follows only its own B- or I-."""
    bad = np.zeros((n + 1, n), bool)
    for inside in range(2, n, 2):
        bad[:, inside] = True
        bad[inside - 1, inside] = bad[inside, inside] = False
    return bad


def viterbi(emitted: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags for scores of tokens (n, tags) and of moves between tags (tags + 1, tags; the last row is the start)."""
    n, kinds = emitted.shape
    if not n:
        return np.empty(0, np.int64)
    back = np.zeros((n, kinds), np.int8)
    score = emitted[0] + moves[kinds]
    for i in range(1, n):
        by = score[:, None] + moves[:kinds]
        back[i] = by.argmax(0)
        score = by.max(0) + emitted[i]
    best = np.empty(n, np.int64)
    best[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        best[i - 1] = back[i, best[i]]
    return best


def viterbi_all(weights: np.ndarray, moves: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
    """viterbi() of many texts, given their slots: a step takes the next word of each."""
    kinds = weights.shape[1]
    told: list[np.ndarray] = [np.empty(0, np.int64)] * len(seen)
    order = sorted((i for i in range(len(seen)) if len(seen[i])), key=lambda i: -len(seen[i]))
    while order:
        longest = len(seen[order[0]])
        now, order = order[: max(1, AT_ONCE // longest)], order[max(1, AT_ONCE // longest) :]
        sizes = np.array([len(seen[i]) for i in now])
        ends = np.cumsum(sizes)
        flat = _emitted(weights, np.concatenate([seen[i] for i in now]))
        starts = ends - sizes
        open_ = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with a word at each step: the first ones, as longer ones come first
        back = np.zeros((longest, len(now), kinds), np.int8)
        score = flat[starts] + moves[kinds]
        for i in range(1, longest):
            k = open_[i]
            by = score[:k, :, None] + moves[:kinds]
            back[i, :k] = by.argmax(1)
            score[:k] = by.max(1) + flat[starts[:k] + i]
        best = np.empty(len(flat), np.int64)
        tag = score.argmax(1)
        best[ends - 1] = tag
        for i in range(longest - 1, 0, -1):
            k = open_[i]
            tag[:k] = back[i, np.arange(k), tag[:k]]
            best[starts[:k] + i - 1] = tag[:k]
        for i, own in zip(now, np.split(best, ends[:-1])):
            told[i] = own
    return told


def _emitted(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    total = np.zeros((len(seen), weights.shape[1]))
    for k in range(seen.shape[1]):
        total += weights[seen[:, k]]
    return total


def gold(places: list[tuple[int, int]], spans: list[dict], tags: list[str]) -> np.ndarray:
    """Tags of words that spans touch; of spans that share a word the longest counts, then the first."""
    out = np.zeros(len(places), np.int64)
    starts, ends = [p[0] for p in places], [p[1] for p in places]
    for s in sorted(spans, key=lambda s: (s["start"] - s["end"], s["start"], s["label"])):
        first, last = int(np.searchsorted(ends, s["start"], "right")), int(np.searchsorted(starts, s["end"], "left"))
        if first < last and not out[first:last].any():
            begin = tags.index(f"B-{s['label']}")
            out[first], out[first + 1 : last] = begin, begin + 1
    return out


class _Shard:
    """One pass over one shard from given weights: their changes, and the same times the step at which they came."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves, self.steps = weights.copy(), moves.copy(), 0
        self.ahead = 1
        self.changes = [(np.zeros_like(weights), np.zeros_like(moves)) for _ in range(2)]

    def learn(self, lessons: list[tuple[np.ndarray, np.ndarray]], bad: np.ndarray) -> None:
        """Learns from (slots, tags) of texts one after the other."""
        at = 0
        while at < len(lessons):
            ahead = lessons[at : at + self.ahead]
            told = viterbi_all(self.weights, np.where(bad, -np.inf, self.moves), [seen for seen, _ in ahead])
            wrong = next((i for i, (own, (_, true)) in enumerate(zip(told, ahead)) if (own != true).any()), None)
            if wrong is None:
                self.steps += len(ahead)
                self.ahead = min(2 * self.ahead, AHEAD)
            else:
                # What came before is right, so it changes nothing; what comes after is decoded again.
                self.steps += wrong
                self._change(*ahead[wrong], told[wrong])
                self.steps += 1
                self.ahead = max(1, (wrong + 1 + self.ahead) // 3)
            at += len(ahead) if wrong is None else wrong + 1

    def _change(self, seen: np.ndarray, true: np.ndarray, told: np.ndarray) -> None:
        wrong = np.flatnonzero(told != true)
        start = self.weights.shape[1]
        now, late = self.changes
        for rows, moves, by in ((self.weights, self.moves, 1.0), (*now, 1.0), (*late, float(self.steps))):
            for tags, sign in ((true, by), (told, -by)):
                np.add.at(rows, (seen[wrong], tags[wrong][:, None]), sign)
                np.add.at(moves, (np.concatenate([[start], tags[:-1]]), tags), sign)

    def rows(self) -> list[tuple[int, list[float], list[float]]]:
        """(slot, change, change of the mean over all steps); moves have slots after those of weights."""
        (w, m), (late_w, late_m) = self.changes
        change, late = np.vstack([w, m]), np.vstack([late_w, late_m])
        mean = change - late / max(self.steps, 1)
        at = np.flatnonzero(change.any(1) | late.any(1))
        return [(int(i), change[i].tolist(), mean[i].tolist()) for i in at]


@dataclass
class Tagger:
    """Labels, weights (2**bits, tags) and moves (tags + 1, tags)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of the names in a text."""
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """find() of each text."""
        kinds = 1 + 2 * len(self.labels)
        places = [words(text) for text in texts]
        seen = [slots([text[s:e] for s, e in own], self.bits) for text, own in zip(texts, places)]
        told = viterbi_all(self.weights, np.where(forbidden(kinds), -np.inf, self.moves), seen)
        return [self._names(*x) for x in zip(places, told)]

    def _names(self, places: list[tuple[int, int]], told: np.ndarray) -> list[tuple[int, int, str]]:
        found: list[list] = []
        for i in np.flatnonzero(told).tolist():
            (start, end), tag = places[i], int(told[i])
            if tag % 2:
                found.append([start, end, self.labels[tag // 2]])
            else:
                found[-1][1] = end
        return [tuple(f) for f in found]


def train(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id", epochs: int = EPOCHS, shards: int = SHARDS, bits: int = BITS) -> Tagger:
    """A tagger learnt from all rows of docs and the names in them: spans of key, start, end (characters from 0) and label.

    Rows with a null key or an empty text, spans without a label or of no length teach nothing; rows without spans teach that there are no
    names. Repeated rows count as often as they are there. More than MOST_LABELS labels are a ValueError. The result doesn't
    depend on how rows lie in partitions: a row's shard and turn come from a hash of its text.
    """
    named = spans.where(F.col("label").isNotNull() & (F.col("start") < F.col("end"))).select(F.col(key).alias("key"), F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("label").cast("string").alias("label")).alias("span"))
    labels = sorted(r[0] for r in named.select("span.label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    tags, count = tags_of(labels), 1 << bits
    size, kinds = count + len(tags) + 1, len(tags)
    by_key = named.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    rows = docs.where(F.col(key).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), F.col(text).alias("text")).join(by_key, "key", "left")
    turn = F.xxhash64("text")
    lessons = cut(rows.select(F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), turn.alias("turn"), "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")))
    weights, moves = np.zeros((count, kinds)), np.zeros((kinds + 1, kinds))
    total = np.zeros((size, kinds))
    for _ in range(epochs):
        held = docs.sparkSession.sparkContext.broadcast((weights, moves))  # 2**bits rows of kinds numbers

        def epoch(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bad, at, learner = forbidden(kinds), None, None

            def done() -> pa.RecordBatch:
                made = [(size, [1.0] * kinds, [1.0] * kinds), *learner.rows()]
                wide = pa.list_(pa.float64())
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int32()), pa.array([r[1] for r in made], wide), pa.array([r[2] for r in made], wide)], names=["slot", "change", "mean"])

            def lesson(body: str, names: list[dict]) -> tuple[np.ndarray, np.ndarray]:
                places = words(body)
                return slots([body[s:e] for s, e in places], bits), gold(places, names, tags)

            for batch in batches:
                # Some texts at a time: their slots are about 40 bytes a word.
                for i in range(0, batch.num_rows, 4 * AHEAD):
                    few = batch.slice(i, 4 * AHEAD)
                    for shard, rows in groupby(zip(*[c.to_pylist() for c in few.columns]), key=lambda r: r[0]):
                        if shard != at:
                            if learner:
                                yield done()
                            at, learner = shard, _Shard(*held.value)
                        learner.learn([x for x in (lesson(*r[1:]) for r in rows) if len(x[0])], bad)
            if learner:
                yield done()

        # By number, not by hash, which would put several shards into one task.
        ordered = lessons.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "turn", "text").select("shard", "text", "spans")
        told = ordered.mapInArrow(epoch, "slot int, change array<double>, mean array<double>")
        sums = [F.sum(F.get(c, F.lit(j))).alias(f"{c}{j}") for c in ("change", "mean") for j in range(kinds)]
        change, mean = np.zeros((size + 1, kinds)), np.zeros((size + 1, kinds))
        for r in told.groupBy("slot").agg(*sums).collect():  # at most size + 1 rows
            change[r[0]], mean[r[0]] = r[1 : 1 + kinds], r[1 + kinds :]
        learnt = max(change[size, 0], 1.0)  # shards with rows
        before = np.vstack([weights, moves])
        total += before + mean[:size] / learnt
        after = before + change[:size] / learnt
        weights, moves = after[:count], after[count:]
        held.unpersist()
    total = total / max(epochs, 1)
    return Tagger(labels, total[:count], total[count:])


def tag(docs: DataFrame, tagger: Tagger, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text, label, description, start, end, source: a row for each name that the tagger sees in the whole text of each row.

    Null and empty texts hold none; repeated rows give theirs again.
    """
    # Short texts are few bytes and much work.
    slim = spread(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = slim.schema["key"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    shape = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "text": pa.string(), "label": pa.string()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4 * AHEAD):
                few = batch.slice(i, 4 * AHEAD)
                texts = few.column(1).to_pylist()
                found = [[{"start": s, "end": e, "text": body[s:e], "label": x} for s, e, x in names] for body, names in zip(texts, model.find_all(texts))]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(found, shape)], names=["key", "found"])

    hits = slim.mapInArrow(run, f"key {kind}, found {_FOUND}").select("key", F.explode("found").alias("f"))
    return hits.select(F.col("key").alias(key), "f.text", "f.label", description("f.label").alias("description"), "f.start", "f.end", F.lit("learnt").alias("source"))


def agreement(found: DataFrame, true: DataFrame, key: str = "doc_id") -> DataFrame:
    """label, gold, found, both: how many different names (key, start, end, label) each side has, and how many are the same."""
    of = lambda df, side: df.select(key, "start", "end", "label").distinct().withColumn(side, F.lit(1))
    joined = of(true, "gold").join(of(found, "found"), [key, "start", "end", "label"], "full")
    return joined.groupBy("label").agg(F.count("gold").alias("gold"), F.count("found").alias("found"), F.count(F.col("gold") + F.col("found")).alias("both"))
