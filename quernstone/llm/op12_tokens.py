"""Token counts by heap-and-linked-list byte-pair merging; no identifier is made.

A text is normalised as the vocabulary's model says (a space in front, spaces made visible) and cut
into runs no piece of the vocabulary reaches across. Within a run the symbols form a linked list and
all adjacent pairs that spell a piece wait in a heap; the pair of the lowest rank, leftmost first, is
merged until none is left. The count is the number of symbols at first less the merges; a character
that is no piece itself and was never merged counts its UTF-8 bytes (byte fallback). Runs repeat a
lot, so counts of short runs are remembered within a task.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The character that stands for a space in pieces.
SPACE = "▁"
#: Runs of at most so many characters are remembered, so many of them at once; either bounds memory alone, not what is counted.
SHORT_RUN, REMEMBERED = 32, 300_000
#: Characters of a text cut into runs at once.
STRETCH = 1 << 20


class Vocabulary:
    """Ranks of the pieces, 0 merged first, and the characters that are pieces by themselves.

    A few hundred kilobytes for a vocabulary of 32,000, broadcast to the tasks.
    """

    def __init__(self, scores: dict[str, float], lead: bool = True):
        order = {s: rank for rank, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[s] for piece, s in scores.items() if len(piece) > 1}
        self.single = frozenset(piece for piece in scores if len(piece) == 1)
        self.lead = SPACE if lead else ""

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """The vocabulary of a sentencepiece file; its model must be byte-pair merging with byte fallback and change nothing but spaces."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if not any(map(model.is_byte, ids)):
            raise ValueError(f"{path}: a vocabulary without bytes has unknown tokens, which aren't counted here")
        trial = "  aÅ ﬁ①\t́ "
        normal = model.normalize(trial)
        shown = trial.replace(" ", SPACE)
        if normal not in (shown, SPACE + shown):
            raise ValueError(f"{path}: its model rewrites characters, which isn't done here")
        own = [i for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        found = cls({model.id_to_piece(i): model.get_score(i) for i in own}, normal != shown)
        if model.encode("the then", out_type=str) != [SPACE + "the", SPACE + "then"] or found.count("the then") != 2:
            raise ValueError(f"{path}: not a model of byte-pair merging")
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("ranks", "single", "lead")}

    @cached_property
    def runs(self) -> re.Pattern:
        """Runs that no merge crosses: a character of no longer piece stands alone, and where no piece holds
        a space after another character, a run ends before its spaces."""
        inner = {c for piece in self.ranks for c in piece}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ranks):
            within = "".join(map(re.escape, sorted(inner)))
            return re.compile(f"[{within}]+|[^{within}]", re.S)
        within = "".join(map(re.escape, sorted(inner - {SPACE})))
        return re.compile(f"{SPACE}*[{within}]+|{SPACE}+|[^{within}{SPACE}]", re.S)

    @cached_property
    def known(self) -> _Known:
        return _Known(self)

    def merged(self, run: str) -> int:
        """Tokens of one run."""
        ranks, piece = self.ranks, list(run)
        n = tokens = len(piece)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank * n + i for i in range(n - 1) if (rank := ranks.get(piece[i] + piece[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = right[i]
            # An entry is stale if its first symbol was merged away or its pair has become another one.
            if not piece[i] or j >= n or ranks.get(piece[i] + piece[j]) != rank:
                continue
            piece[i] += piece[j]
            piece[j] = ""
            tokens -= 1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                if (rank := ranks.get(piece[i] + piece[after])) is not None:
                    heapq.heappush(heap, rank * n + i)
            before = left[i]
            if before >= 0 and (rank := ranks.get(piece[before] + piece[i])) is not None:
                heapq.heappush(heap, rank * n + before)
        return tokens + sum(len(c.encode()) - 1 for c in piece if len(c) == 1 and c not in self.single)

    def count(self, text: str) -> int:
        """Tokens of one text."""
        if not text:
            return 0
        shown = self.lead + text.replace(" ", SPACE)
        if len(shown) <= STRETCH:
            return sum(map(self.known.__getitem__, self.runs.findall(shown)))
        return sum(self.known[m.group()] for m in self.runs.finditer(shown))


class _Known(dict):
    """Tokens of short runs, filled as they are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, run: str) -> int:
        n = self.vocabulary.merged(run)
        if len(run) <= SHORT_RUN:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n


def token_counts(docs: DataFrame, vocabulary: Vocabulary, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row of docs, whatever its other columns.

    n_tokens is what the vocabulary's own library gives without begin and end; strings that look like special tokens are ordinary text.
    Null and empty texts have no token. Rows that repeat, or have a null key, each get their row; an empty table gives an
    empty one. Any length is counted whole: time grows with n log n of the longest run at worst.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    slim = docs.select(F.col(key).alias("k"), F.octet_length(text_of(text)).cast("long").alias("b"), text_of(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.count
        for batch in batches:
            tokens = np.fromiter((of(value.as_py()) for value in batch.column(2)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens)], names=["k", "b", "t"])

    counted = slim.mapInArrow(count, f"k {slim.schema[0].dataType.simpleString()}, b long, t long")
    return counted.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("t").alias("n_tokens"), (F.col("t") > limit).alias("over_limit"))
