"""Mixing sources to target weights by systematic sampling.

Every source gets a target share of the mix, capped at a multiple of its own size. A document of
the source is then expected target / size times. Expected copies are prefix-summed within the source, a
random offset is added once, and a document is emitted once for each integer boundary that its stretch crosses.
Documents are taken in order of size class, so a source's sum strays from its target by little more than one document.

The prefix sums are exact integers (fixed point), made in three levels of counts, so that even
a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, text_of

#: Binary digits after the point of expected copies and offsets.
POINT = 28


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_class(size: Column) -> Column:
    """Number of digits and first two digits: classes at most a tenth wide, the same in any engine."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target from source, source_size (a row for each source).

    Sources in code-point order, null last, take the weights in turn. Targets share `share` times
    all sizes by weight, but stop at `most` times the source's size, the excess reshared by weight
    until none is above. In closed form: with sources ordered by cap / weight, the capped ones are
    a prefix, the first k for which the rest, shared by weight, lifts no further source above its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto, before = by_cap.rowsBetween(Window.unboundedPreceding, 0), by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = weighted.select(
        "*",
        (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("open"),
    )
    # A source is capped if its equal share of what the sources before it leave exceeds its cap.
    settled = level.withColumn("rate", F.col("left") / F.col("open")).withColumn("capped", F.col("rate") * F.col("weight") > F.col("cap"))
    final = settled.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rate"))).over(everything)["rate"])
    return final.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def _drawn(slim: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """slim, a table of id, source, size, spread and twin (and others), with source_size, target and copies."""
    rows = slim.withColumn("label", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("band", size_class(F.col("size"))).withColumn("cell", F.col("spread"))

    cells = cut(rows.groupBy("label", "source", "band", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    bands = cells.groupBy("label", "source", "band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    sources = cut(source_targets(bands.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rate = F.coalesce(F.round(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) * (1 << POINT)), F.lit(0.0)).cast("long")
    labelled = sources.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("label"), "source_size", "target", rate.alias("rate"))

    def before(*levels: str):
        *outer, last = levels
        return F.coalesce(F.sum("n").over(Window.partitionBy(*outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    bands = bands.select("label", "band", before("label", "band").alias("band_start"))
    starts = cells.select("label", "band", "cell", before("label", "band", "cell").alias("cell_start"))
    starts = starts.join(small(bands), ["label", "band"]).join(small(labelled), "label").withColumn("start", F.col("band_start") + F.col("cell_start"))

    place = F.row_number().over(Window.partitionBy("label", "band", "cell").orderBy("size", "id", "twin")).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("label"))), 1, 7), 16, 10).cast("long")
    ranked = rows.withColumn("place", place).join(starts.select("label", "band", "cell", "start", "source_size", "target", "rate"), ["label", "band", "cell"])
    rank = F.col("start") + F.col("place")
    crossed = F.shiftright(offset + F.col("rate") * rank, POINT) - F.shiftright(offset + F.col("rate") * (rank - 1), POINT)
    return ranked.withColumn("copies", crossed.cast("int"))


def _slim(key: str, text: str, source: str) -> list[Column]:
    """id, source, size, spread (a hash of the key, of the text where that is null: one of 256) and twin, which tells rows of a key apart."""
    spread = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), text_of(text))), 1, 2)
    return [F.col(key).alias("id"), F.col(source).cast("string").alias("source"), words_in(text_of(text)).alias("size"), spread.alias("spread"), F.crc32(text_of(text)).alias("twin")]


def mixture(docs: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size, source_size, target, copies, taken for each row of docs.

    size is the number of words of the text (null: 0); null is a source like others. Documents
    without words belong to the mix like others. Rows that are repeated, or share a null key, are drawn one by one. The same rows and seed
    give the same copies, however the rows are stored. No rows give no rows.
    """
    drawn = _drawn(cut(docs.select(*_slim(key, text, source))), weights, share, most, seed)
    return drawn.select(F.col("id").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Rows that share a key (null too) are drawn one by one, as in `mixture`. The rows are written once with a number each, by which the copies are joined to them.
    """
    whole = cut(docs.select(F.struct(*docs.columns).alias("row"), *_slim(key, text, source), F.monotonically_increasing_id().alias("number")))
    drawn = _drawn(whole.drop("row"), weights, share, most, seed).where("copies > 0").select("number", "copies")
    return whole.select("number", "row").join(drawn, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
