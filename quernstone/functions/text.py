"""Expressions over texts: tokens, structure, noise, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks dialogue and code, how labels are introduced, and the step of words for text quality.
DIALOGUE = r"(^|\n)(User:|Assistant:|Q:|A:|Speaker)"
CODE = r"(def |class |#include|console\.log|public static|import )"
NOISE = r"[^a-zA-Z0-9\s]"
LABEL_LEADS = ("this message is a ", "this message is ", "this is a ", "this is ", "the message is ", "request to ", "a ")
QUALITY_STEPS = ((0, 0.0), (1, 0.35), (3, 0.55), (10, 0.75), (50, 0.90))
QUALITY_BEST = 0.95


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once even where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def blank(text: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(text)), F.lit(0)) == 0


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def words(text: Column | str) -> Column:
    """White-space tokens, none of them empty."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(r"\S+"))


def noise_ratio(text: Column | str) -> Column:
    """Share of characters other than ASCII letters, digits and white space; 0 for empty text."""
    return F.coalesce(F.regexp_count(col(text), F.lit(NOISE)) / F.nullif(F.length(col(text)), F.lit(0)), F.lit(0.0))


def has_dialogue(text: Column | str) -> Column:
    return col(text).rlike(DIALOGUE)


def has_code(text: Column | str) -> Column:
    return col(text).rlike(CODE)


def lexical_diversity(text: Column | str) -> Column:
    """Distinct over all tokens; 0 without tokens."""
    return let(words(text), lambda w: F.coalesce(F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)), F.lit(0.0)))


def chunks(text: Column | str, size: int = 1000) -> Column:
    """Array of texts of `size` tokens each, joined by a space; no tokens give no chunks."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, size)))

    return let(words(text), cut)


def head(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def keyword_text(name: Column | str, keywords: Column | str) -> Column:
    """Document name and keywords, joined by a space."""
    return F.concat_ws(" ", F.array_prepend(col(keywords), col(name)))


def clean_label(label: Column | str) -> Column:
    """Lower-cased label without its introduction (the first that fits, tried in order), underscores as spaces."""
    lead = "^(" + "|".join(LABEL_LEADS) + ")"
    return strip(F.translate(F.regexp_replace(strip(F.lower(col(label))), lead, ""), "_", " "))


def star_sentiment(stars: Column | str) -> Column:
    """Label of a five-star model: one or two stars negative, three neutral, others positive."""
    s = col(stars)
    return F.when(s.contains("1") | s.contains("2"), "negative").when(s.contains("3"), "neutral").otherwise("positive")


def text_quality(text: Column | str) -> Column:
    """0 for blank text, else by number of tokens."""
    n = word_count(F.coalesce(col(text), F.lit("")))
    result = F.lit(QUALITY_BEST)
    for most, value in reversed(QUALITY_STEPS):
        result = F.when(n <= most, F.lit(value)).otherwise(result)
    return result


def megabytes(size: Column | str) -> Column:
    return F.round(col(size) / F.lit(1024 * 1024), 3)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def outer_json(text: Column | str) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"(?s)\{.*\}", 0), F.lit(""))


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-cased, with the dot; empty if there is none."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]*)$", 1))
