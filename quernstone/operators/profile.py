"""Corpus reports: ingestion statistics and the dataset profile, each one aggregate pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, has_code, has_dialogue, megabytes, noise_ratio, safe_ratio
from ..session import spread

# Which ratios decide on the dataset type, in this order.
CHAT_ABOVE, CODE_ABOVE, LANGUAGES_ABOVE = 0.4, 0.3, 2


def ingestion_stats(docs: DataFrame, lang: str = "lang", form: str = "format", words: Column | str = "words", size: Column | str = "size", duplicates: Column | None = None) -> DataFrame:
    """One row: total_docs, languages, formats, duplicates, avg_length (truncated mean of words), total_size_mb."""
    return docs.agg(
        F.count("*").alias("total_docs"),
        F.array_sort(F.collect_set(lang)).alias("languages"),
        F.array_sort(F.collect_set(form)).alias("formats"),
        (F.lit(0) if duplicates is None else duplicates).cast("long").alias("duplicates"),
        F.coalesce(F.floor(F.avg(col(words))), F.lit(0)).cast("long").alias("avg_length"),
        F.coalesce(megabytes(F.sum(col(size))), F.lit(0.0)).alias("total_size_mb"),
    )


def distribution(docs: DataFrame, key: str, count: str = "n") -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias(count))


def members(docs: DataFrame, topic: str, doc_id: str = "doc_id") -> DataFrame:
    """topic, doc_ids in order."""
    return docs.groupBy(topic).agg(F.array_sort(F.collect_list(doc_id)).alias("doc_ids"))


def member_blocks(docs: DataFrame, topic: str, doc_id: str = "doc_id", most: int = 10_000) -> DataFrame:
    """topic, block, doc_ids in order: documents by hash in blocks of about `most` of the corpus, so that no row grows with a topic."""
    blocks = max(1, -(-docs.count() // most))
    return docs.groupBy(topic, F.pmod(F.xxhash64(doc_id), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(doc_id)).alias("doc_ids"))


def dataset_type(dialogue: Column, code: Column, languages: Column) -> Column:
    return F.when(dialogue > CHAT_ABOVE, "chat_dataset").when(code > CODE_ABOVE, "technical_dataset").when(languages > LANGUAGES_ABOVE, "multilingual_dataset").otherwise("mixed_dataset")


def dataset_profile(docs: DataFrame, text: str = "text", lang: str = "lang", topic: str = "topic") -> DataFrame:
    """One row: type, size, topics with sizes, mean noise, dialogue and code ratios, languages.

    Ratios are over the rows whose text is known. Rows are first combined by topic and language, then into the
    one row, so that the last step only sees as many rows as there are such pairs.
    """
    known = F.col(text).isNotNull()
    parts = spread(docs.select(text, lang, topic)).groupBy(F.col(topic).alias("topic"), F.col(lang).alias("lang")).agg(
        F.count("*").alias("n"),
        F.count(F.when(known, 1)).alias("known"),
        F.sum(F.when(known, noise_ratio(text))).alias("noise"),
        F.count(F.when(has_dialogue(text), 1)).alias("dialogue"),
        F.count(F.when(has_code(text), 1)).alias("code"),
    )
    counted = lambda key: parts.groupBy(key).agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(key, F.lit("unknown")), "n")))).alias(f"by_{key}"))
    total = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "known", "noise", "dialogue", "code")])
    whole = total.crossJoin(F.broadcast(counted("topic"))).crossJoin(F.broadcast(counted("lang")))  # one row each
    dialogue, code = safe_ratio(F.col("dialogue"), F.col("known")), safe_ratio(F.col("code"), F.col("known"))
    return whole.select(
        dataset_type(dialogue, code, F.size("by_lang")).alias("probable_dataset_type"),
        F.col("n").alias("total_documents"),
        F.map_keys("by_topic").alias("topics_detected"),
        F.col("by_topic").alias("cluster_sizes"),
        F.round(safe_ratio(F.col("noise"), F.col("known")), 4).alias("avg_noise_ratio"),
        F.round(dialogue, 4).alias("dialogue_ratio"),
        F.round(code, 4).alias("code_ratio"),
        F.col("by_lang").alias("language_distribution"),
    )


def head_sample(docs: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by `order` (a capped sample is the operator's purpose)."""
    return docs.orderBy(order).limit(n)


def batch_summary(labelled: DataFrame) -> DataFrame:
    """One row: rows, average confidence, rows for review."""
    return labelled.agg(F.count("*").alias("rows"), F.round(F.avg("confidence_score"), 4).alias("avg_confidence"), F.count(F.when(F.col("needs_review"), 1)).alias("needs_review"))
