"""Entities: extraction by rules (or a model plug-in), validation, dedup and corpus shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, head, let

# Entity types that count, their descriptions, the shortest entity and words that are none.
TYPES = ("PERSON", "ORG", "GPE", "LOC", "DATE", "TIME", "MONEY", "PRODUCT", "EVENT", "LAW", "NORP", "FAC", "WORK_OF_ART", "PER", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC")
DESCRIPTIONS = {
    "PERSON": "Person name",
    "PER": "Person name",
    "ORG": "Organization",
    "GPE": "Country / City / State",
    "LOC": "Geographic location",
    "DATE": "Date or period",
    "TIME": "Time",
    "MONEY": "Monetary value",
    "PRODUCT": "Product name",
    "EVENT": "Event",
    "LAW": "Legal document",
    "NORP": "Nationality / Religion / Political group",
}
SHORTEST = 2
NOT_NUMBERS = ("PERSON", "PER", "ORG")
COMMON = ("veux", "want", "need", "have", "the", "a", "an", "is", "are", "je", "tu", "il", "elle", "nous", "vous", "ils", "ma", "mon", "le", "la", "les", "de", "du", "des", "en", "un", "une")
MODEL_LABELS = {"PER": "PERSON", "LOC": "GPE", "ORG": "ORG", "MISC": "PRODUCT"}
PREFIX = 5000

#: Default rules: label and pattern (RE2 and Java alike).
RULES = (
    ("MONEY", r"[$€£] ?[0-9]+(?:[.,][0-9]+)*"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("TIME", r"[0-9]{1,2}:[0-9]{2}"),
    ("ORG", r"[A-Z][A-Za-z]+ (?:Inc|Ltd|GmbH|SARL|Corp)"),
    ("PERSON", r"(?:Mr|Mrs|Dr|Mme)\. [A-Z][a-z]+"),
    ("PRODUCT", r"[A-Z]{2,}[0-9]+[A-Z0-9]*"),
)


def normalise_label(label: Column | str) -> Column:
    """Without B- and I-, and by the names in use here."""
    plain = F.regexp_replace(col(label), "[BI]-", "")
    known = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


def description(label: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(label)), col(label))


def valid(text: Column | str, label: Column | str) -> Column:
    t, name = F.trim(col(text)), col(label)
    return (F.length(t) >= SHORTEST) & name.isin(*TYPES) & ~(t.rlike(r"(?U)^\d+$") & name.isin(*NOT_NUMBERS)) & ~F.lower(t).isin(*COMMON)


def rule_entities(text: Column | str) -> Column:
    """array<struct(text, label, description)>: what the rules find in the first PREFIX characters, valid, each once."""

    def by_rule(label: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(head(text, PREFIX), F.lit(f"({pattern})"), F.lit(1))
        return F.transform(hits, lambda t: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(DESCRIPTIONS.get(label, label)).alias("description")))

    found = F.concat(*[by_rule(label, pattern) for label, pattern in RULES])
    return distinct_entities(F.filter(found, lambda e: valid(e["text"], e["label"])))


def distinct_entities(entities: Column) -> Column:
    """The first of each (lower-cased text, label), order kept."""

    def key(e: Column) -> Column:
        return F.concat_ws("\u0001", F.lower(e["text"]), e["label"])

    def firsts(all_of: Column) -> Column:
        return let(F.transform(all_of, key), lambda keys: F.filter(all_of, lambda e, i: F.array_position(keys, key(e)) == i + 1))

    return let(entities, firsts)


def with_fallback(first: Column, second: Column) -> Column:
    """second where first found nothing."""
    return F.when(F.size(first) > 0, first).otherwise(second)


def entity_shares(docs: DataFrame, entities: str = "entities") -> DataFrame:
    """label, n, share of all entities."""
    counts = docs.select(F.explode(F.transform(entities, lambda e: e["label"])).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
