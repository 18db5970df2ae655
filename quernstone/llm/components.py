"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """vertex, label from edges a, b (long): label is the smallest vertex of the component.

    Each round works on an edge list that never grows; the number of rounds grows with the logarithm
    of the longest path. Vertices without an edge to another don't appear. The smallest neighbours are
    tables of their own, so that the join can split the edges of a vertex with very many of them.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen or not sign[0]:
            break
        seen = sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lowest = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())
