"""Model plug-ins. A model is a function from a text column to a column; the defaults need no downloads.

Defaults are deterministic stand-ins with the interface, thresholds and post-processing of the trained
models they replace (sentence embedding, zero-shot classification, entities, sentiment, translation).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank, col, words

EMBEDDING_SIZE = 256
_WORD = re.compile(r"\w+")


@lru_cache(1 << 16)
def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode())


def _places(word: str, size: int) -> tuple[int, ...]:
    grams = [_hash(word[i : i + 3]) for i in range(len(word) - 2)] if len(word) > 3 else []
    own = zlib.crc32(word.encode())
    return tuple([x % size for x in (own, own, *grams)])


_known_places = lru_cache(1 << 16)(_places)


def embed(text: str | None, size: int = EMBEDDING_SIZE) -> np.ndarray:
    """Hashed counts of lower-cased words (twice) and their letter trigrams, of length 1."""
    places = [x for word in _WORD.findall((text or "").lower()) for x in (_known_places if len(word) <= 32 else _places)(word, size)]
    out = np.bincount(np.array(places, dtype=np.int64), minlength=size).astype(float)
    length = np.linalg.norm(out)
    return out / length if length else out


def embedding(text: Column | str) -> Column:
    """Default sentence embedding, array<double>; an Arrow-batched UDF that a real model can replace."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([embed(t) for t in texts], dtype=object)

    return vectors(col(text))


def model_udf(load: Callable[[], Callable[[list[str]], list]], schema: str) -> Callable[[Column | str], Column]:
    """Wrap a batch model: `load` runs once for each Python worker's iterator, its result on lists of texts."""
    from collections.abc import Iterator

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    wrapped = F.pandas_udf(run, schema)
    return lambda text: wrapped(col(text))


# Small word lists of our own for the default sentiment model.
POSITIVE = ("good", "great", "excellent", "happy", "love", "thanks", "merci", "bon", "super", "gut", "bueno")
NEGATIVE = ("bad", "terrible", "unhappy", "hate", "worst", "broken", "mauvais", "nul", "schlecht", "malo")


def star_rating(text: Column | str) -> Column:
    """struct(label, score) with a label like "4 stars": default rating by word lists, all in SQL expressions."""
    tokens = words(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}]+", " "))
    good = F.size(F.filter(tokens, lambda w: w.isin(*POSITIVE)))
    bad = F.size(F.filter(tokens, lambda w: w.isin(*NEGATIVE)))
    stars = F.when(good > bad + 1, 5).when(good > bad, 4).when(good == bad, 3).when(bad > good + 1, 1).otherwise(2)
    label = F.concat(stars.cast("string"), F.when(stars == 1, " star").otherwise(" stars"))
    return F.struct(label.alias("label"), F.round(0.5 + 0.5 * F.abs(good - bad) / F.greatest(good + bad, F.lit(1)), 4).alias("score"))


def untranslated(text: Column | str) -> Column:
    """Default French to English translation: none; texts come back as they are."""
    return F.when(blank(text), F.lit("")).otherwise(col(text))
