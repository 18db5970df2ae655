"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests, one for each partition and then added up, name every digest
that can hold more than about 2 / COUNTERS of the rows. Those candidates are counted exactly, their winners
are broadcast (at most COUNTERS rows) and resolve the rows of hot digests without a shuffle. All
other digests are resolved by one shuffle of slim rows, in which no group can be large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

#: Counters of a Misra-Gries summary; bounds what is broadcast.
COUNTERS = 1024


def misra_gries(counts: dict, fresh: pd.Series, k: int) -> dict:
    """Merge exact counts of a batch into a summary of k counters (the mergeable form).

    Each digest's count is too low by at most (all counted so far) / (k + 1).
    """
    for key, n in fresh.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= k:
        return counts
    cutoff = sorted(counts.values(), reverse=True)[k]
    return {key: n - cutoff for key, n in counts.items() if n > cutoff}


def heavy_candidates(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each that holds over 2 / counters of the rows."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for pdf in batches:
            counts = misra_gries(counts, pdf[column].value_counts(), counters)
        yield pd.DataFrame({column: list(counts), "n": list(counts.values())})

    rows = digests.count()
    summed = digests.select(column).mapInPandas(summarise, f"{column} binary, n long").groupBy(column).agg(F.sum("n").alias("n"))
    # All counters together are at most the rows, so under `counters` digests can pass this.
    return summed.where(F.col("n") > rows / counters).where(F.col("n") > 1).select(column)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as empty. The row with the largest key
    stays (null keys come last; of rows that repeat key and text, one stays). An empty input gives
    an empty result. Other columns are ignored, whatever their names.
    """
    digests = cut(docs.select(F.col(key).alias("id"), F.unhex(F.sha2(text_of(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    who = F.struct("id", "row")
    winners = cut(
        digests.join(F.broadcast(heavy_candidates(digests, "digest", counters)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(who).alias("best"), F.count("*").alias("group_size"))
    )  # at most `counters` rows
    hot = digests.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", F.max(who).over(same).alias("best"), F.count("*").over(same).alias("group_size"))
    return hot.unionByName(rest).select(
        F.col("id").alias(key),
        F.col("best.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
