"""Key phrases against a plain version that takes the terms' scores from term_features, which SQL checks in test_catalogue."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quernstone.operators import phrases

TEXTS = {
    1: "Spark runs Python code. The Spark engine of ACME Corp joins large tables; large tables are split.\nSpark engines join tables! ACME Corp 2024 report, the annual report of Acme.",
    2: "le chat est sur la table et le chien dort\nune maison rouge près de la mer",
    3: None,
    4: "... !!! 12 34",
    5: "the of and to",
    6: "Über Straßen und Wälder. Über Wälder und Straßen? Große Straßen",
    7: "alpha beta gamma delta " * 40,
}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def stop(w):
    return len(w) < phrases.SHORTEST or w in phrases.STOPS


def plain_phrases(text, score, k=20, longest=3, same=0.9):
    counts = Counter()
    for sentence in re.split(r"[.!?\n]+", text or ""):
        for stretch in re.split(r"[^\w \t]+|_+", sentence):
            words = [w for w in re.split(r"[ \t]+", stretch.lower()) if w]
            for i in range(len(words)):
                for n in range(1, longest + 1):
                    run = tuple(words[i : i + n])
                    if len(run) == n and not stop(run[0]) and not stop(run[-1]) and not any(c.isnumeric() for w in run for c in w):
                        counts[run] += 1
    ranked = []
    for run, n in counts.items():
        product, total = 1.0, 0.0
        for w in run:
            if not stop(w):
                product, total = product * score[w], total + score[w]
        ranked.append((round(product / (n * (1 + total)), 9), " ".join(run)))
    kept = []
    for s, p in sorted(ranked):
        if len(kept) < k and all(1 - distance(p, q) / max(len(p), len(q)) < same for _, q in kept):
            kept.append((s, p))
    return [p for _, p in kept]


def test_phrases_against_a_plain_version(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "key", "row", "term", "words")})
    scores = defaultdict(dict)
    for r in phrases.term_features(docs).collect():
        scores[r["doc_id"]][r["term"]] = r["score"]
    for options in ({}, {"k": 3, "longest": 2, "same": 0.5}):
        got = defaultdict(list)
        for r in sorted(phrases.key_phrases(docs, **options).collect(), key=lambda r: (r["doc_id"], r["rank"])):
            got[r["doc_id"]].append(r["phrase"])
        want = {k: plain_phrases(t, scores[k], **options) for k, t in TEXTS.items()}
        assert dict(got) == {k: v for k, v in want.items() if v}
    assert "acme corp" in got[1] or "spark" in got[1]


def test_capitals_places_and_neighbours_count(spark):
    docs = spark.createDataFrame([(1, "we met Paris today. " + "we met rome today. " + "the end")], "doc_id long, text string")
    score = {r["term"]: r["score"] for r in phrases.term_features(docs).collect()}
    assert score["paris"] < score["rome"]
    # Spelt nearly alike: only the better one stays.
    copies = spark.createDataFrame([(1, "container containers other. container ships")], "doc_id long, text string")
    found = {r["phrase"] for r in phrases.key_phrases(copies, longest=1).collect()}
    assert len(found & {"container", "containers"}) == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one lonely phrase"), (2, "same words here"), (2, "same words here"), (3, "word " * 60_000)], "doc_id long, text string")
    rows = phrases.key_phrases(docs).collect()
    assert {r["doc_id"] for r in rows} == {None, 2, 3}
    assert sum(r["doc_id"] == 2 and r["rank"] == 1 for r in rows) == 2
    assert phrases.key_phrases(docs.where("false")).collect() == []


def test_nothing_moves_and_pieces_of_a_batch_agree(spark, monkeypatch):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    want = sorted((r["doc_id"], r["rank"], r["phrase"], r["score"]) for r in phrases.key_phrases(docs).collect())
    terms = sorted(tuple(r) for r in phrases.term_features(docs).collect())
    monkeypatch.setattr(phrases, "AT_ONCE", 50)
    monkeypatch.setattr(phrases, "spread", lambda df: df.coalesce(1))
    for made, rows in ((phrases.key_phrases(docs), want), (phrases.term_features(docs), terms)):
        assert sorted(tuple(r) for r in made.collect()) == rows
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_exact_deviation(spark):
    """Counts 1, 3, 1, 3: mean 2 and deviation 1 exactly, so that no half of a last digit is missed."""
    docs = spark.createDataFrame([(1, "alpha gamma gamma gamma. delta omega omega omega")], "doc_id long, text string")
    assert {r["frequency"] for r in phrases.term_features(docs).collect()} == {1 / 3, 1.0}
