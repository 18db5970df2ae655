"""Nulls, repeated rows and keys, very long texts, clashing columns and empty tables; learning and alignment against plain versions."""

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import common, queries
from quernstone.llm import op08_quality as quality
from quernstone.llm import op10_decontaminate as leak
from quernstone.llm.op01_mix import mix, mixture
from quernstone.llm.op03_nearjoin import keep_one
from quernstone.llm.op07_lines import line_dedup
from quernstone.llm.op09_chat import chat_format, formatted, read_back
from quernstone.llm.wordhash import words_of

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_draws_rows_of_one_key_apart(spark):
    rows = [(None, f"{'word ' * 9}{i}", "en", "a", 1) for i in range(100)] + [(7, "same text here", "en", "b", 1)] * 40 + [(8, "other text here", "en", "b", 1), (8, None, "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("copies", "number", "row", "size", "label")})
    drawn = mixture(docs, (1.0, 1.0), 0.5).collect()
    mixed = mix(docs, (1.0, 1.0), 0.5).collect()
    want = Counter()
    for r in drawn:
        want[r["source"]] += r["copies"]
    assert Counter(r["source"] for r in mixed) == +want and mixed[0].asDict().keys() == set(docs.columns)
    target = {r["source"]: r["target"] for r in drawn}
    assert abs(sum(len(r["text"].split()) for r in mixed if r["source"] == "a") - target["a"]) <= 15
    assert 0 < sum(r["doc_id"] is None for r in mixed) < 100


def test_keep_one_and_decontaminate_with_null_and_repeated_keys(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text.upper()), (None, text), (None, "alone here"), (3, None), (3, ""), (4, f"well {text}")], "doc_id long, text string").withColumn("gone key", F.lit(1))
    kept = [(r["doc_id"], r["text"]) for r in keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, text), (1, text), (None, text), (None, "alone here"), (3, None), (3, "")], key=str)
    items = spark.createDataFrame([(1, text), (2, "alone"), (3, None), (1, text)], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in leak.decontaminate(docs.where("doc_id is not null"), items).collect()]
    assert sorted(left, key=str) == [(3, ""), (3, None)]
    # Null keys go together: one of them holds the item.
    assert leak.decontaminate(docs, items).where("doc_id is null").count() == 0


def test_short_items_mark_nothing(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "on the mat"), (3, "cat sat on the mat")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leak.contaminated(docs, items).collect()] == [(1, 3)]


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    item = [f"i{x}" for x in range(40)]
    words = [f"w{x}" for x in rng.integers(0, 50_000, 300_000)]
    words[200_000:200_000] = item
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words)), (3, "\n".join(words[:1000]))], "doc_id long, text string")
    found = leak.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["score"], r["end_word"]) for r in found) == [(1, 1.0, 200_040), (2, 1.0, 200_040)]
    common_keys = set(words) & set(words[:1000])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup(docs, 2).collect()}
    assert got == {1: (1, 0), 2: (300_040, sum(w in common_keys for w in words)), 3: (1000, 1000)}
    turns = spark.createDataFrame([(1, 1, "user", "### " * 200_000), (1, 2, "assistant", "\\ </turn> " * 100_000)], "conv_id long, turn long, role string, text string")
    back = chat_format(turns).select(read_back(formatted(F.col("segments"))).alias("t")).first()["t"]
    assert [tuple(t) for t in back] == [("user", "### " * 200_000), ("assistant", "\\ </turn> " * 100_000)]


def test_lines_of_text_keys(spark):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "x"), (None, "x\nz")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "-", r["n_lines"], r["n_dropped"]) for r in line_dedup(docs, 3).collect())
    assert got == [("-", 2, 1), ("a", 2, 1), ("b", 1, 1)]


def test_settled_deletes_what_was_written_on_the_way(spark):
    before = len(common._written)
    kept = common.settled(lambda: common.cut(common.cut(spark.range(5)).where("id > 1")).where("id > 2"))
    assert sorted(r[0] for r in kept.collect()) == [3, 4] and len(common._written) == before + 1
    assert common.fresh("Score", ["score", "score_"]) == "Score__"


# -- learning ----------------------------------------------------------------


def plain_ftrl(vectors, labels, size, epochs, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """Follow the regularised leader, a coordinate at a time."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for (at, x), y in zip(vectors, labels):
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for i, v, wi in zip(at, x, w):
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * wi
                n[i] += g * g
    return [weight(i) for i in range(size)]


def test_learning_against_a_plain_loop():
    rng = np.random.default_rng(9)
    vectors = [(np.sort(rng.choice(50, 8, replace=False)), rng.random(8)) for _ in range(120)]
    labels = rng.integers(0, 2, 120).astype(float)
    model = quality.Ftrl(50)
    for _ in range(3):
        for (at, x), y in zip(vectors, labels):
            model.update(at, x, y)
    assert np.allclose(model.weights(), plain_ftrl(vectors, labels, 50, 3), atol=1e-12)


def test_features_against_a_plain_count():
    texts = ["a b a b c", "", "x", "a b c d e f g a b"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    words = words_of(np.frombuffer(data, dtype=np.uint8), offsets)
    first, _, value = quality.features_of(words, np.diff(offsets))
    for t, a, b in zip(texts, first, first[1:]):
        w = t.split()
        counts = Counter(w) + Counter(zip(w, w[1:]))
        norm = sum(n * n for n in counts.values()) ** 0.5
        assert sorted(np.round(value[a:b], 9)) == sorted(np.round([*(n / norm for n in counts.values()), *[0.5] * 4], 9))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op8_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 30 and len(bad) > 3 and auc > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


# -- alignment ---------------------------------------------------------------


@tables
def test_leaks_against_all_pairs(spark):
    """Every document aligned whole with every item, without seeds or bounds."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def hashes(text):
        data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
        return words_of(data, np.array([0, len(data)])).hashes

    held = [(i, hashes(t)) for i, t in items]
    want = {}
    for d, text in docs:
        words = hashes(text)
        for i, item in held:
            score = leak.local_alignment(item, words)[0] / (leak.MATCH * len(item)) if len(words) else 0
            if score >= queries.LEAK_SCORE:
                want[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.QUERIES["op10_decontaminate"](spark, DATA).collect()}
    assert got == want and len(want) >= 3


# -- the pipeline's stages ---------------------------------------------------


def folder_with(spark, path, docs):
    """Test tables with these documents."""
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


@tables
def test_stages_on_odd_rows(spark, tmp_path):
    extra = ("score", "score_", "pii", "lower text", "copies", "number", "row", "doc", "drawn key", "gone key", "bad key")
    some = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (5, "the same row", "en", "s", 1), (5, "the same row", "en", "s", 1), (10**9, "\x00 \n\t", "en", None, 1), (10**9 + 1, "word " * 50_000, "en", "s", 1)], SCHEMA)
    docs = some.unionByName(odd).withColumns({c: F.lit(c) for c in extra})
    d = folder_with(spark, tmp_path, docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        assert made.columns == (docs.columns if k < 4 else [*docs.columns, "shard", "slot"])
        rows = made.collect()
        assert rows and all(r[c] == c for r in rows for c in extra)


@tables
def test_stages_on_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    d = folder_with(spark, tmp_path, docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, d)
        assert made.collect() == [] and made.columns == (docs.columns if k < 4 else [*docs.columns, "shard", "slot"])
    assert corpus_pipeline.run(spark, d).collect() == []


@tables
def test_shares_of_the_shards_query(spark):
    """Sizes, checksums, gapless slots and counts of the registered query, by plain means."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    slots = {}
    for r in queries.QUERIES["op5_shard"](spark, DATA).collect():
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]]), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(slots) == list(range(24))
