"""Key phrases of single documents from the statistics of their own terms, after the published YAKE features.

A term counts as important if it is written with capitals, comes early, is frequent, is spread over sentences and
has few different neighbours on either side; a phrase by its terms and how often it occurs. Low scores are
good. A document says all about itself, so nothing moves: texts are cut into words by expressions and Arrow, and some
megabytes of them at a time become features and phrases as arrays of numbers of words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .language import STOP_WORDS

#: Words of a phrase at most, phrases of a document, and the similarity of spelling from which the worse phrase goes.
LONGEST, PHRASES, SAME = 3, 20, 0.9
#: Words of fewer characters count as stop words.
SHORTEST = 3
STOPS = tuple(sorted({w for words in STOP_WORDS.values() for w in words}))
_STOPS = frozenset(STOPS)
#: Bytes of texts that are arrays at once, but for a longer text.
AT_ONCE = 2 << 20


def _marked(text: Column) -> Column:
    """The words of a text, with a full stop by itself between sentences and a comma between stretches without punctuation."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N} \t.!?\n]+", " , "), r"[.!?\n]+", " . ")


def _stop(word: str) -> bool:
    return len(word) < SHORTEST or word in _STOPS


def _digit(word: str) -> bool:
    return not word.isalpha() and any(unicodedata.category(c)[0] == "N" for c in word)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


class _Texts:
    """Words of some texts in their order, and the terms of each text ("groups"), by text and number of the term; names has the terms."""

    def __init__(self, texts: pa.Array) -> None:
        pieces = pc.ascii_split_whitespace(texts)
        flat = pieces.flatten().dictionary_encode()
        spelt = flat.dictionary.to_pylist()
        at: dict[str, int] = {}
        low = [w.lower() for w in spelt]
        own = np.array([at.setdefault(w, len(at)) for w in low], np.int64)
        self.names = list(at)
        kind = np.array([".,".find(w) + 1 if len(w) < 2 else 0 for w in spelt], np.int8)  # an empty piece is found at 0
        empty = np.array([w == "" for w in spelt], bool)
        code = flat.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
        kinds = np.where(empty[code], 3, kind[code])
        word = kinds == 0
        # Both rise with the text, so that they differ where any border lies between.
        sentence, stretch = (np.cumsum(m) + row for m in (kinds == 1, (kinds == 1) | (kinds == 2)))
        code, self.row, sentence, stretch = code[word], row[word], sentence[word], stretch[word]
        self.opens, self.cut = _firsts(sentence), _firsts(stretch)
        number = np.cumsum(self.opens) - 1
        starts = np.flatnonzero(_firsts(self.row))
        self.sentence = number - np.repeat(number[starts], np.diff(np.append(starts, len(number))))
        self.term = own[code]
        self.width = max(1, len(self.names))
        pair, self.first, self.group, self.tf = np.unique(self.row * self.width + self.term, return_index=True, return_inverse=True, return_counts=True)
        self.group_row, self.group_term = pair // self.width, pair % self.width
        self.acronym = np.array([w != x and len(w) > 1 and w.upper() == w for w, x in zip(spelt, low)], bool)[code]
        self.named = np.array([w != x and w[0] != w[0].lower() for w, x in zip(spelt, low)], bool)[code]
        self.stop = np.array([_stop(w) for w in self.names], bool)

    def _different(self, side: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The share of different terms in those beside the words of each group."""
        size = len(self.tf)
        pairs = np.sort(self.group[there] * self.width + side[there])
        return np.bincount(pairs[_firsts(pairs)] // self.width, minlength=size) / np.maximum(np.bincount(self.group[there], minlength=size), 1)

    def features(self) -> dict[str, np.ndarray]:
        size, tf = len(self.tf), self.tf
        follows = ~self.cut  # has a word to its left
        leads = np.append(follows[1:], False)
        left, right = self._different(np.roll(self.term, 1), follows), self._different(np.roll(self.term, -1), leads)
        acronym, name = (np.bincount(self.group[m], minlength=size) for m in (self.acronym, self.named & ~self.opens))
        # The sentences of each group in their order.
        order = np.argsort(self.group, kind="stable")
        group, sentence = self.group[order], self.sentence[order]
        once = _firsts(group) | _firsts(sentence)
        group, sentence = group[once], sentence[once]
        among = np.bincount(group, minlength=size)
        start = np.cumsum(among) - among
        median = (sentence[start + (among - 1) // 2] + sentence[start + among // 2]) / 2
        rows = int(self.row[-1]) + 1
        most, sentences = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        np.maximum.at(most, self.group_row, tf)
        np.maximum.at(sentences, self.row, self.sentence + 1)
        plain = ~self.stop[self.group_term]
        of, n = self.group_row[plain], tf[plain]
        count = np.maximum(np.bincount(of, minlength=rows), 1)
        total, squares = (np.bincount(of, x, minlength=rows) for x in (n, np.square(n, dtype=np.float64)))
        usual = (total / count + np.sqrt(np.maximum(count * squares - total * total, 0)) / count)[self.group_row]  # sums of whole numbers, exact
        case, position = np.maximum(acronym, name) / np.log(1.0 + tf), np.log(np.log(3 + median))
        frequency = np.where(usual == 0, 0.0, tf / np.where(usual == 0, 1.0, usual))
        related = 1 + (left + right) * tf / most[self.group_row]
        part = among / sentences[self.group_row]
        return {"case": case, "position": position, "frequency": frequency, "related": related, "spread": part, "score": related * position / (case + (frequency + part) / related)}

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place of its first word, score) of each different phrase of n words, for n from 1 on."""
        score = self.features()["score"][self.group]
        stop = self.stop[self.term]
        digit = np.array([_digit(w) for w in self.names], bool)[self.term]
        factor, part = np.where(stop, 1.0, score), np.where(stop, 0.0, score)
        code, product, total, fit = self.group, factor, part, ~digit
        for n in range(1, longest + 1):
            at = np.flatnonzero(fit & ~stop[: len(fit)] & ~stop[n - 1 :])
            _, first, count = np.unique(code[at], return_index=True, return_counts=True)
            place = at[first]
            yield self.row[place], place, _round9(product[place] / (count * (1 + total[place])))
            if n == longest or len(code) < 2:
                return
            # Runs of n words get numbers, so that they and a next word have one.
            code = np.unique(code[:-1], return_inverse=True)[1] * len(self.tf) + self.group[n:]
            product, total = product[:-1] * factor[n:], total[:-1] + part[n:]
            fit = fit[:-1] & ~digit[n:] & ~self.cut[n:]


def _round9(x: np.ndarray) -> np.ndarray:
    return np.where(x < 1e6, np.floor(x * 1e9 + 0.5) / 1e9, x)


def _edits(share: float, longer: int) -> int:
    """Edits of strings whose longer length is given, at most, if they are alike; told exactly by _spelt_alike."""
    return int((1 - share) * longer + 1e-6)


def _spelt_alike(a: str, b: str, same: float) -> bool:
    """Whether 1 - (edit distance over the longer length) is `same` or more."""
    longer = max(len(a), len(b))
    most = _edits(same, longer)
    if abs(len(a) - len(b)) > most:
        return False
    # What both begin and end with needs no edit.
    i, end = 0, min(len(a), len(b))
    while i < end and a[i] == b[i]:
        i += 1
    j = 0
    while j < end - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        if min(new) > most:
            return False
        row = new
    return 1 - row[-1] / longer >= same


def _letters(word: str) -> int:
    """A bit for each letter of a word, with its code modulo 64; an edit changes two at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << (ord(c) & 63)
    return bits


def _best(texts: _Texts, k: int, longest: int, same: float) -> Iterator[tuple[int, list[str], list[float]]]:
    """(text, phrases, scores), best first, ties by spelling; a phrase that is spelt like a better one is left out."""
    if not len(texts.row):
        return
    found = list(texts.runs(longest))
    row, place, score = (np.concatenate([f[i] for f in found]) for i in range(3))
    size = np.repeat(np.arange(1, len(found) + 1), [len(f[0]) for f in found])
    order = np.lexsort((score, row))
    row, place, score, size = row[order], place[order], score[order], size[order]
    border = np.append(np.flatnonzero(_firsts(row)), len(row))
    names, term = texts.names, texts.term
    letters: dict[int, int] = {}
    for start, end in zip(border[:-1].tolist(), border[1:].tolist()):
        phrases: list[str] = []
        scores: list[float] = []
        kept: list[tuple[int, int, str]] = []  # length, letters and spelling
        i, step = start, max(64, 2 * k)
        while i < end and len(phrases) < k:
            # Some of the best at a time; those that tie with the last of them come along.
            j = min(end, i + step)
            j += int(np.searchsorted(score[j:end], score[j - 1], "right")) if j < end else 0
            ids = [term[p : p + n].tolist() for p, n in zip(place[i:j].tolist(), size[i:j].tolist())]
            for s, phrase, own in sorted(zip(score[i:j].tolist(), (" ".join([names[x] for x in w]) for w in ids), ids)):
                if len(phrases) == k:
                    break
                bits = 0
                for x in own:
                    if x not in letters:
                        letters[x] = _letters(names[x])
                    bits |= letters[x]
                n = len(phrase)
                if not any((bits ^ o).bit_count() <= 2 * _edits(same, max(n, m)) and _spelt_alike(phrase, other, same) for m, o, other in kept):
                    kept.append((n, bits, phrase))
                    phrases.append(phrase)
                    scores.append(s)
            i = j
        yield int(row[start]), phrases, scores


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """batches in slices of AT_ONCE bytes of a text column, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")))
            yield batch.slice(i, j - i)
            i = j


def map_texts(docs: DataFrame, text: str, make: Callable[[pa.RecordBatch, _Texts], pa.RecordBatch | None], fields: list[T.StructField], *keep: Column) -> DataFrame:
    """What make(columns of keep, texts) returns for some rows of docs at a time, without a shuffle (but for an input of few splits)."""
    held = spread(docs.select(F.col(text).alias("text"), *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 0):
            made = make(piece, _Texts(piece.column(0)))
            if made is not None:
                yield made

    return held.select(_marked(F.col("text")).alias("text"), *held.columns[1:]).mapInArrow(run, T.StructType(fields))


def term_features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, term, tf, case, position, frequency, related, spread, score: every term of each row of docs. Null and empty texts have none."""
    names = ["case", "position", "frequency", "related", "spread", "score"]

    def make(rows: pa.RecordBatch, texts: _Texts) -> pa.RecordBatch | None:
        if not len(texts.row):
            return None
        found = texts.features()
        return pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(texts.group_row)), pa.array(texts.names, pa.string()).take(pa.array(texts.group_term)), pa.array(texts.tf.astype(np.int64)), *[pa.array(found[c]) for c in names]], names=["key", "term", "tf", *names])

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    return map_texts(docs, text, make, fields, F.col(key).alias("key")).withColumnRenamed("key", key)


def best_phrases(docs: DataFrame, k: int, longest: int, same: float, text: str, *keep: Column) -> DataFrame:
    """The columns of keep and phrases, scores (the k best, as key_phrases() has them) of each row of docs, in its order."""

    def make(rows: pa.RecordBatch, texts: _Texts) -> pa.RecordBatch:
        found: list[tuple[list[str], list[float]]] = [([], [])] * rows.num_rows
        for i, *own in _best(texts, k, longest, same):
            found[i] = tuple(own)
        lists = [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*rows.columns[1:], *lists], names=[*rows.schema.names[1:], "phrases", "scores"])

    kept = docs.select(*keep).schema.fields
    return map_texts(docs, text, make, [*kept, T.StructField("phrases", T.ArrayType(T.StringType())), T.StructField("scores", T.ArrayType(T.DoubleType()))], *keep)


def key_phrases(docs: DataFrame, k: int = PHRASES, longest: int = LONGEST, same: float = SAME, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, rank, phrase, score: the k best phrases of each row of docs, best first, ties by spelling.

    A phrase is a run of at most `longest` words without punctuation; it neither begins nor ends with a stop word and holds no digit. Stop
    words inside it count for nothing. Rows without a phrase, null and empty texts among them, have none; rows that repeat
    a key are documents of their own.
    """
    best = best_phrases(docs, k, longest, same, text, F.col(key).alias("key"))
    return best.select(F.col("key").alias(key), F.posexplode(F.arrays_zip("phrases", "scores")).alias("at", "p")).select(key, (F.col("at") + 1).alias("rank"), F.col("p.phrases").alias("phrase"), F.col("p.scores").alias("score"))
