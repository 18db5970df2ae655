"""The sequence labeller: decoding against enumeration, learning against a plain loop, names it has never seen."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import tagger as tg

PLACES = ["Ruritania", "Sylvania", "Borduria", "Elbonia", "Freedonia", "Qumar", "Latveria", "Genovia"]
REGIONS = ["North Reach", "Iron Coast", "Old Vale"]


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(5)
    for kinds in (1, 3, 5):
        bad = tg.forbidden(kinds)
        for n in range(5):
            emitted, moves = rng.normal(size=(n, kinds)), np.where(bad, -np.inf, rng.normal(size=(kinds + 1, kinds)))
            score = lambda tags: sum(emitted[i, t] + moves[tags[i - 1] if i else kinds, t] for i, t in enumerate(tags))
            best = max(product(range(kinds), repeat=n), key=score)
            assert tuple(tg.viterbi(emitted, moves)) == best


def test_inside_follows_its_own_begin():
    tags = tg.tags_of(["GPE", "LOC"])
    bad = tg.forbidden(len(tags))
    allowed = {(tags[a] if a < len(tags) else "start", tags[b]) for a in range(len(tags) + 1) for b in range(len(tags)) if not bad[a, b]}
    assert {a for a, b in allowed if b == "I-LOC"} == {"B-LOC", "I-LOC"} and ("start", "B-GPE") in allowed and ("start", "I-GPE") not in allowed


def test_spans_become_tags():
    places = tg.words("The North Reach of Sylvania")
    span = lambda s, e, x: {"start": s, "end": e, "label": x}
    spans = [span(4, 9, "GPE"), span(4, 15, "LOC"), span(19, 27, "GPE"), span(90, 95, "GPE")]
    assert [tg.tags_of(["GPE", "LOC"])[i] for i in tg.gold(places, spans, tg.tags_of(["GPE", "LOC"]))] == ["O", "B-LOC", "I-LOC", "O", "B-GPE"]


def sentences(places, start=0):
    texts, spans = [], []
    for i in range(240):
        place, region = places[i % len(places)], REGIONS[i // 7 % 3]
        parts = [[("Ships left ", None), (place, "GPE"), (" for the ", None), (region, "LOC"), (".", None)], [("The ", None), (place + "n", "NORP"), (" king of ", None), (place, "GPE"), (" sleeps", None)], [("Nothing happened on Monday, Peter said.", None)]][i % 3]
        text = ""
        for piece, label in parts:
            if label:
                spans.append((start + i, len(text), len(text) + len(piece), label))
            text += piece
        texts.append((start + i, text))
    return texts, spans


def test_names_never_seen(spark):
    texts, spans = sentences(PLACES[:6])
    fresh, truth = sentences(PLACES[6:], 1000)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "spans", "label", "shard")})
    spanned = lambda rows: spark.createDataFrame(rows, "doc_id long, start int, end int, label string")
    odd = [(None, "x y"), (7000, None), (7001, ""), (7002, " \n")]
    lessons = make([*texts, *odd])
    names = spanned([*spans, (7000, 0, 3, "GPE"), (None, 0, 1, "GPE"), (1, 3, 3, "GPE"), (1, 0, 2, None)])
    model = tg.train(lessons, names, shards=3, bits=12)
    found = tg.tag(make([*fresh, *odd]), model)
    rows = {r["label"]: r for r in tg.agreement(found, spanned(truth)).collect()}
    assert set(rows) == {"GPE", "LOC", "NORP"}
    for r in rows.values():
        assert 2 * r["both"] / (r["gold"] + r["found"]) >= 0.95
    for r in found.limit(50).collect():
        assert dict(fresh)[r["doc_id"]][r["start"] : r["end"]] == r["text"] and r["source"] == "learnt"
    # The order and places of rows change nothing.
    again = tg.train(lessons.repartition(7).orderBy(F.desc("doc_id")), names, shards=3, bits=12)
    assert np.allclose(model.weights, again.weights, atol=1e-9) and np.allclose(model.moves, again.moves, atol=1e-9)


def plain(lessons, labels, epochs, bits):
    """The same for one shard, without hashing tricks: weights after each sentence are summed up."""
    tags = tg.tags_of(labels)
    kinds = len(tags)
    bad = tg.forbidden(kinds)
    w, m = np.zeros((1 << bits, kinds)), np.zeros((kinds + 1, kinds))
    means = []
    for _ in range(epochs):
        kept = []
        for text, spans in lessons:
            kept.append((w.copy(), m.copy()))
            places = tg.words(text)
            seen, true = tg.slots([text[s:e] for s, e in places], bits), tg.gold(places, spans, tags)
            score = lambda y: sum(sum(w[s, y[i]] for s in seen[i]) + (-np.inf if bad[y[i - 1] if i else kinds, y[i]] else m[y[i - 1] if i else kinds, y[i]]) for i in range(len(y)))
            told = max(sorted(product(range(kinds), repeat=len(places)), key=lambda y: y[::-1]), key=score)  # ties as the decoder breaks them
            for y, by in ((true, 1), (told, -1)):
                for i, tag in enumerate(y):
                    m[y[i - 1] if i else kinds, tag] += by
                    for s in seen[i]:
                        if told[i] != true[i]:
                            w[s, tag] += by
        kept = kept[1:] + [(w.copy(), m.copy())]
        means.append((np.mean([k[0] for k in kept], axis=0), np.mean([k[1] for k in kept], axis=0)))
    return np.mean([x[0] for x in means], axis=0), np.mean([x[1] for x in means], axis=0)


def test_learning_against_a_plain_loop(spark):
    texts = ["in Qumar now", "the Old Vale", "Qumar rose", "no name here", "to Genovia"]
    spans = [(0, 3, 8, "GPE"), (1, 4, 12, "GPE"), (2, 0, 5, "GPE"), (4, 3, 10, "GPE")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = [r[0] for r in docs.orderBy(F.xxhash64("text")).collect()]
    lessons = [(texts[i], [{"start": s, "end": e, "label": x} for k, s, e, x in spans if k == i]) for i in order]
    want = plain(lessons, ["GPE"], 3, 8)
    got = tg.train(docs, spark.createDataFrame(spans, "doc_id long, start int, end int, label string"), epochs=3, shards=1, bits=8)
    assert np.allclose(got.weights, want[0]) and np.allclose(got.moves, want[1])


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, start int, end int, label string")
    for rows in (docs, docs.where("false")):
        model = tg.train(rows, none, bits=6)
        assert model.labels == [] and tg.tag(docs, model).collect() == []


def test_very_long_text():
    model = tg.Tagger(["GPE"], np.zeros((64, 3)), np.zeros((4, 3)))
    assert model.find("word " * 100_000) == [] and model.find("") == []


def test_many_texts_at_once_equal_one_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    kinds, weights = 5, rng.integers(-2, 3, size=(64, 5)).astype(float)
    moves = np.where(tg.forbidden(kinds), -np.inf, rng.integers(-2, 3, size=(kinds + 1, kinds)))
    seen = [rng.integers(0, 64, size=(n, 10)) for n in (0, 3, 1, 9, 3, 40, 0, 1)]
    for at_once in (1, 12, 100_000):
        monkeypatch.setattr(tg, "AT_ONCE", at_once)
        assert all((a == tg.viterbi(tg._emitted(weights, s), moves)).all() for a, s in zip(tg.viterbi_all(weights, moves, seen), seen))
    bad = tg.forbidden(kinds)
    lessons = [(s, np.where(rng.random(len(s)) < 0.3, 1, 0)) for s in seen * 4 if len(s)]
    one, many = (tg._Shard(np.zeros((64, kinds)), np.zeros((kinds + 1, kinds))) for _ in range(2))
    for lesson in lessons:
        one.learn([lesson], bad)
    many.learn(lessons, bad)
    assert one.rows() == many.rows() and one.steps == many.steps == len(lessons) and (one.weights == many.weights).all()


def test_each_shard_is_a_task(spark):
    rows = spark.range(64).select((F.col("id") % 8).cast("int").alias("shard"))
    held = rows.repartitionById(8, F.col("shard")).select(F.spark_partition_id().alias("p"), "shard").distinct().collect()
    assert len({r["p"] for r in held}) == len(held) == 8
