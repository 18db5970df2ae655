"""Incremental ingestion (an extension): new files are deduplicated against all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators.dedup import content_hash
from ..operators.language import detect_language


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", per_trigger: int = 16) -> DataFrame:
    """Parquet documents that arrive in a folder, each text once, with language and word count.

    The state holds one digest a text. Which of several equal texts stays is the first to arrive.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return docs.withColumn("digest", content_hash("text")).dropDuplicates(["digest"]).withColumns({"detected": detect_language("text"), "words": word_count("text")})


def stream_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events by type and tumbling window, late ones up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
