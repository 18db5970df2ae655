"""Random walks on terms against a dense solve; ratings by hand."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import polarity as po
from quernstone.operators import wordvectors as wv

ENTRIES = "a string, b string, ppmi double"
SEEDS = "term string, side int"


def solved(entries, seeds, restart):
    names = sorted({a for a, _, _ in entries})
    at = {x: i for i, x in enumerate(names)}
    e = np.zeros((len(names),) * 2)
    for a, b, w in entries:
        e[at[a], at[b]] += w
    d = e.sum(1)
    t = e / np.sqrt(np.outer(d, d))
    out = []
    for sign in (1, -1):
        s = np.zeros(len(names))
        for term, side in set(seeds):
            if term in at and side * sign > 0:
                s[at[term]] = 1
        s /= s.sum() or 1
        out.append(np.linalg.solve(np.eye(len(names)) - (1 - restart) * t, restart * s))
    idle = np.sqrt(d) / np.sqrt(d).sum()
    return {x: (p, n, (p + i) / (p + n + 2 * i)) for x, p, n, i in zip(names, *out, idle) if p + n > 0}


def same(got, want, tolerance):
    rows = {r["term"]: r for r in got.collect()}
    assert set(rows) == set(want)
    for term, values in want.items():
        assert np.allclose([rows[term][c] for c in ("positive", "negative", "polarity")], values, atol=tolerance)


def test_walk_is_the_fixed_point_on_the_small_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    entries = wv.ppmi(wv.cooccurrences(docs))
    rows = [(r["a"], r["b"], r["ppmi"]) for r in entries.collect()]
    often = [x for x, _ in Counter(a for a, _, _ in rows).most_common(8)]
    seeds = [(x, 1 if i % 2 else -1) for i, x in enumerate(often)]
    same(po.walk(entries, spark.createDataFrame(seeds, SEEDS)), solved(rows, seeds, po.RESTART), 1e-6)


def test_odd_seeds_and_graphs(spark):
    half = [("good", "fine", 2.0), ("fine", "plain", 1.0), ("plain", "poor", 1.0), ("poor", "bad", 3.0), ("plain", "plain", 0.5), ("far", "away", 1.0)]
    rows = half + [(b, a, w) for a, b, w in half if a != b]
    entries = spark.createDataFrame([(*r, "x") for r in rows], ENTRIES + ", term string")
    seeds = [("good", 1), ("good", 5), ("bad", -1), ("plain", 1), ("plain", -1), ("nowhere", 1)]
    made = po.walk(entries, spark.createDataFrame([*seeds, (None, 1), ("fine", None), ("fine", 0)], SEEDS), rounds=40)
    same(made, solved(rows, [(t, int(math.copysign(1, s))) for t, s in seeds], po.RESTART), 1e-9)
    told = {r["term"]: r["polarity"] for r in made.collect()}
    assert told["good"] > told["fine"] > 0.5 > told["poor"] > told["bad"] and "far" not in told
    one = {r["term"]: r for r in po.walk(entries, spark.createDataFrame([("good", 1)], SEEDS), rounds=3).collect()}
    assert all(r["negative"] == 0 and r["polarity"] > 0.5 for r in one.values())
    assert po.walk(entries, spark.createDataFrame([], SEEDS), rounds=2).collect() == []
    assert po.walk(entries.where("false"), spark.createDataFrame(seeds, SEEDS), rounds=2).collect() == []


def test_seeds_by_odds(spark):
    texts = [("awful day", 1), ("awful awful night", 1), ("lovely day", 0), ("lovely night", 0), ("day night", 0), ("lost", None), ("other", 2), (None, 1), ("", 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(texts)], "doc_id long, text string, flag string")
    marked = spark.createDataFrame([(i, f) for i, (_, f) in enumerate(texts)], "doc_id long, toxic int")
    rows = {(r["term"], r["side"]): r["odds"] for r in po.seed_terms(docs, marked, k=1, min_docs=2).collect()}
    assert set(rows) == {("awful", -1), ("lovely", 1)}
    assert rows[("awful", -1)] == round(math.log(2.5 * 4.5 / (0.5 * 1.5)), 6)
    assert po.seed_terms(docs, marked.where("false")).collect() == []


def test_ratings(spark):
    lexicon = spark.createDataFrame([("lovely", 0.9), ("awful", 0.1), ("day", 0.5), ("so", 0.55)], "term string, polarity double")
    texts = ["Lovely, lovely day", "awful day", "day", "unknown", "", None, "lovely awful", "so so awful lovely", "lovely lovely " * 50_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "y", 2)], "doc_id long, text string, mean string, id int")
    got = sorted((r["doc_id"], r["label"], r["mean"], r["score"]) for r in po.rate(docs, lexicon).collect())
    mean = round((2 * 0.1 * 0.1 + 0.64 - 0.64) / (0.2 + 1.6), 6)
    assert got[:2] == [(0, "5 stars", 0.8, 0.9)] * 2 and [g[:3] for g in got[2:]] == [(1, "1 star", -0.8), *((i, "3 stars", 0.0) for i in (2, 3, 4, 5, 6)), (7, "3 stars", mean), (8, "5 stars", 0.8)]
    assert po.rate(docs.where("false"), lexicon).collect() == [] and {r["label"] for r in po.rate(docs, lexicon.where("false")).collect()} == {"3 stars"}
    assert docs.select(F.count("*")).first()[0] == len(got)


def test_walk_on_blocks_is_the_walk_on_entries(spark, monkeypatch):
    monkeypatch.setattr(wv, "PACKED", 50)
    docs = spark.createDataFrame([(i, f"one two w{i % 3} three w{i % 5} four one two" if i % 9 else None) for i in range(60)], "doc_id long, text string")
    words, entries = wv.related(docs)
    names = {r["id"]: r["term"] for r in words.terms.collect()}
    seeds = [("w1", 2), ("w1", 1), ("w4", -1), ("two", 1), ("two", -1), ("nowhere", 1), ("three", 0), (None, 1)]
    table = spark.createDataFrame(seeds, SEEDS)
    _, met = wv.meetings(docs)
    assert set(met.blocks.dtypes) == {(c, "binary") for c in ("a", "size", "b", "n")}
    plain = solved([(names[r["a"]], names[r["b"]], r["ppmi"]) for r in entries.collect()], [(t, int(math.copysign(1, s))) for t, s in seeds if t and s], po.RESTART)
    same(po.walk_words(words.terms, met, table, rounds=40), plain, 1e-9)
    # No seeds, and no words.
    assert po.walk_words(words.terms, met, table.where("term = 'nowhere'")).count() == 0
    none, empty = wv.meetings(docs.where("false"))
    assert po.walk_words(none.terms, empty, table).count() == 0
