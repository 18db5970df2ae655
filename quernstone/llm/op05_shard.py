"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get the numbers 0 to n - 1 in an order that depends on their contents only. A keyed Feistel
network over Z_a x Z_b, with a * b just above n, permutes the numbers; a result beyond n walks on.
Number p then goes to shard p mod shards, slot p div shards: counts differ by one at most, slots
have no gaps, and either can be computed from the row number alone. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

#: Rounds of the network; fewest numbering buckets and most rows of one, about (they decide the numbers, with the row count).
ROUNDS, BUCKETS, BUCKET_ROWS = 6, 4096, 1 << 16


def feistel_domain(n: int) -> tuple[int, int, int]:
    """a, b and how many times a number may have to walk.

    At most a * b - n < a numbers lie beyond n. A walk through them all is short for small n;
    for large n each step ends outside with a chance of about n ** -0.5, so that 24 steps
    fail with a chance below 1e-30 a row, and then the query stops instead of going wrong.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    return a, b, min(a * b - n, 24) + 1


def feistel(number: Column, n: int, seed: int) -> Column:
    """The place of row `number` (0 to n - 1) in the keyed permutation of n numbers."""
    a, b, walks = feistel_domain(n)

    def scramble(half: Column, turn: Column, modulus: int) -> Column:
        return F.pmod(F.xxhash64(half, turn, F.lit(seed).cast("long")), F.lit(modulus).cast("long"))

    def turn_of(at: Column, turn: Column) -> Column:
        left, right = at["l"], at["r"]
        even = turn % 2 == 0
        return F.struct(
            F.when(even, (left + scramble(right, turn, a)) % F.lit(a).cast("long")).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + scramble(left, turn, b)) % F.lit(b).cast("long")).alias("r"),
        )

    def walk(x: Column, _: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), (x % F.lit(b).cast("long")).alias("r"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, turn_of, lambda at: at["l"] * F.lit(b).cast("long") + at["r"])

    first = walk(number, number)
    last = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, i: F.when(x < n, x).otherwise(walk(x, i))) if a * b > n else first
    return F.when(last < n, last).otherwise(F.raise_error(F.lit("a number did not walk back into range")).cast("long"))


def number_rows(rows: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """The n rows with `number`, 0 to n - 1 in an order fixed by the values of `columns`.

    Hash buckets, more of them for more rows, are numbered one after the other: their offsets are prefix
    sums over one count a bucket, and within a bucket a window numbers the rows, so no task holds them all.
    """
    buckets = max(BUCKETS, n // BUCKET_ROWS)
    named = rows.withColumn("number hash", F.xxhash64(*columns)).withColumn("number bucket", F.pmod("number hash", F.lit(buckets)).cast("int"))
    counts = named.groupBy("number bucket").count()
    before = Window.orderBy("number bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("number bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("number offset"))
    within = Window.partitionBy("number bucket").orderBy("number hash", *columns)
    ranked = named.withColumn("number rank", F.row_number().over(within)).join(small(offsets, rows=buckets), "number bucket")
    return ranked.withColumn("number", F.col("number offset") + F.col("number rank") - 1).drop("number hash", "number bucket", "number rank", "number offset")


def _placed(rows: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """rows (id, size, text_crc32 and others) with shard and slot."""
    place = number_rows(rows, n, ["id", "size", "text_crc32"]).withColumn("place", feistel(F.col("number"), n, seed))
    count = F.lit(shards).cast("long")
    return place.withColumns({"shard": F.pmod("place", count).cast("int"), "slot": F.call_function("div", F.col("place"), count)}).drop("number", "place")


def _measured(key: str, text: str) -> dict[str, Column]:
    return {"id": F.col(key), "size": F.octet_length(text_of(text)).cast("long") + 8, "text_crc32": F.crc32(text_of(text))}


def shard(docs: DataFrame, shards: int, seed: int = 20240817, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot for each row of docs.

    The result depends on the rows (key, size and checksum), the seed and the shard count alone, not on
    how they are stored. Null text has size 8 and checksum 0. Rows that are repeated get places of their own.
    Null keys are numbered like others. Other columns are ignored; no rows give no rows.
    """
    slim = cut(docs.select(*[c.alias(name) for name, c in _measured(key, text).items()]))
    return _placed(slim, slim.count(), shards, seed).withColumnRenamed("id", key)


def place_rows(docs: DataFrame, shards: int, seed: int = 20240817, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs with shard and slot as in `shard`; columns of these names are replaced.

    Rows move once, to be numbered.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*columns).alias("row"), *[c.alias(name) for name, c in _measured(key, text).items()])
    return _placed(rows, docs.count(), shards, seed).select("row.*", "shard", "slot")
