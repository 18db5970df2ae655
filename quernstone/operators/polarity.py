"""Sentiment of words and texts without a word list: random walks with restart on the graph of terms.

Two walks, one from a few positive seeds and one from a few negative ones, spread over terms that stand near each other (entries of
positive mutual information, weighed so that frequent terms don't draw everything). A round is a join of the
entries with the walks and one aggregation. A term's polarity is the share of the positive walk in both, drawn to one half by what a walk
without seeds would bring there. Texts are rated by their terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import NARROW_ROWS, cut, small
from .keywords import terms
from .wordvectors import Meetings

#: Seeds of a side, share of a walk that starts anew in each round, rounds (what is left out is (1 - RESTART) ** ROUNDS at most).
SEEDS, RESTART, ROUNDS = 10, 0.5, 24
#: Half width of the band of mean polarity (from -1 to 1) that is three stars, and that of two and four.
BAND, FAR = 0.05, 0.25


def seed_terms(docs: DataFrame, marked: DataFrame, text: str = "text", key: str = "doc_id", flag: str = "toxic", k: int = SEEDS, min_docs: int = 5) -> DataFrame:
    """term, side (-1 or 1), odds: the k terms whose documents are most often flagged, and the k whose are least often.

    marked has key and flag (0 or 1, others and null are left out). Terms in fewer than min_docs marked documents are none. Odds are
    logarithms of smoothed odds with the term against without it; ties go to the first term. A document counts a term once; repeated rows count each.
    """
    known = small(marked.where(F.col(flag).isin(0, 1)).select(F.col(key).alias("key"), F.col(flag).cast("int").alias("flag")))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known, "key").select("flag", F.array_distinct(terms("text")).alias("terms"))
    rows = cut(rows)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("flag"), F.lit(0)).alias("yes")).first()
    counts = rows.select("flag", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("flag").alias("yes")).where(F.col("n") >= min_docs)
    half = F.lit(0.5)
    yes, no = F.col("yes") + half, F.col("n") - F.col("yes") + half
    odds = F.round(F.log(yes * (F.lit(size["n"] - size["yes"]) - F.col("n") + F.col("yes") + half) / (no * (F.lit(size["yes"]) - F.col("yes") + half))), 6)
    rated = cut(counts.select("term", odds.alias("odds")))
    side = lambda order, s: rated.orderBy(order, "term").limit(k).select("term", F.lit(s).alias("side"), "odds")
    return side(F.desc("odds"), -1).unionByName(side(F.asc("odds"), 1))


def walk(entries: DataFrame, seeds: DataFrame, restart: float = RESTART, rounds: int = ROUNDS) -> DataFrame:
    """term, positive, negative, polarity of all terms that a walk reaches on the symmetric entries a, b, ppmi.

    Seeds (term, side above or below 0) that are no term of the entries take no part, a term on both sides counts on both, and repeated seeds once.
    A side without seeds is 0 everywhere. entries are read in each round and should be a table, or cheap to make from one; where its rows lie in ranges of a, a round moves no more than the terms.
    """
    entries = entries.select("a", "b", "ppmi")
    degree = cut(entries.groupBy(F.col("a").alias("term")).agg(F.sum("ppmi").alias("d")))
    of = small(degree, NARROW_ROWS)
    known = seeds.select("term", F.signum("side").alias("side")).distinct().join(degree.select("term"), "term")
    start = known.groupBy("term").agg(F.max((F.col("side") > 0).cast("double")).alias("p"), F.max((F.col("side") < 0).cast("double")).alias("n"))
    size = start.agg(F.sum("p").alias("p"), F.sum("n").alias("n")).first()
    share = lambda c: F.col(c) / F.lit(size[c] or 1.0)
    start = cut(start.select("term", share("p").alias("p"), share("n").alias("n")))
    now = start
    root = F.sqrt("d")
    for _ in range(rounds):
        # A walk leaves a term divided by the root of its degree and arrives so too.
        held = small(cut(now.join(of, "term").select(F.col("term").alias("b"), (F.col("p") / root).alias("p"), (F.col("n") / root).alias("n"))), NARROW_ROWS)
        sums = entries.join(held, "b").groupBy(F.col("a").alias("term")).agg(F.sum(F.col("ppmi") * F.col("p")).alias("p"), F.sum(F.col("ppmi") * F.col("n")).alias("n"))
        near = sums.join(of, "term").select("term", ((1 - restart) * F.col("p") / root).alias("p"), ((1 - restart) * F.col("n") / root).alias("n"))
        again = start.select("term", (restart * F.col("p")).alias("p"), (restart * F.col("n")).alias("n"))
        now = cut(near.unionByName(again).groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    every = degree.agg(F.sum(F.sqrt("d"))).first()[0] or 1.0
    both = now.where(F.col("p") + F.col("n") > 0).join(of, "term").withColumn("idle", F.sqrt("d") / F.lit(every))
    return both.select("term", F.col("p").alias("positive"), F.col("n").alias("negative"), ((F.col("p") + F.col("idle")) / (F.col("p") + F.col("n") + 2 * F.col("idle"))).alias("polarity"))


def walk_words(words: DataFrame, met: Meetings, seeds: DataFrame, restart: float = RESTART, rounds: int = ROUNDS) -> DataFrame:
    """walk() on the positive entries of Meetings of words (id, term), from and to the words. A round reads the blocks once; the walks, two numbers a word, are arrays of the driver."""
    count = len(met.totals)
    degree = met.times(np.ones((count, 1)))[:, 0]
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    known = np.zeros((count, 2))
    for r in seeds.where("side <> 0").join(words, "term").select("id", "side").distinct().toLocalIterator():
        known[r["id"], int(r["side"] < 0)] = 1.0
    known[degree <= 0] = 0.0
    start = known / np.maximum(known.sum(axis=0), 1.0)
    now = start
    for _ in range(rounds):
        # A walk leaves a term divided by the root of its degree and arrives so too.
        now = (1 - restart) * met.times(now / root[:, None]) / root[:, None] + restart * start
    idle = np.where(degree > 0, root, 0.0) / (np.where(degree > 0, root, 0.0).sum() or 1.0)
    at = np.flatnonzero(now.sum(axis=1) > 0)
    (p, n), idle = now[at].T, idle[at]
    made = pa.table({"id": pa.array(at.astype(np.int32)), "positive": pa.array(p.copy()), "negative": pa.array(n.copy()), "polarity": pa.array((p + idle) / (p + n + 2 * idle))})
    table = cut(words.sparkSession.createDataFrame(made, "id int, positive double, negative double, polarity double"))
    return table.join(small(words, NARROW_ROWS), "id").select("term", "positive", "negative", "polarity")


def rate(docs: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, label ("4 stars"), score (0.5 to 1) and mean of each row of docs: the mean of its terms' polarity from -1 to 1, each weighing as much as it is far from 0.

    Rows without a term of the lexicon, null and empty texts among them, have three stars, 0.5 and 0. Repeated rows stay.
    """
    placed = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = placed.select("id", "key", F.explode_outer(terms("text")).alias("term"))
    known = small(cut(lexicon.select("term", (2 * F.col("polarity") - 1).alias("x"))), NARROW_ROWS)
    sums = rows.join(known, "term", "left").groupBy("id", "key").agg(F.sum(F.col("x") * F.abs("x")).alias("x"), F.sum(F.abs("x")).alias("w"))
    mean = F.coalesce(F.round(F.try_divide("x", "w"), 6), F.lit(0.0))
    stars = F.when(F.col("mean") > FAR, 5).when(F.col("mean") > BAND, 4).when(F.col("mean") >= -BAND, 3).when(F.col("mean") >= -FAR, 2).otherwise(1)
    label = F.concat(stars.cast("string"), F.when(stars == 1, " star").otherwise(" stars"))
    return sums.select("key", mean.alias("mean")).select(F.col("key").alias(key), label.alias("label"), F.round(0.5 + F.abs("mean") / 2, 4).alias("score"), "mean")
