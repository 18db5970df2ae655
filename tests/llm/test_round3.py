"""Hard negatives, token counts and fill-in-the-middle against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import op11_negatives as neg
from quernstone.llm.op12_tokens import Vocabulary, token_counts
from quernstone.llm.op13_fim import chunks_of, fill_in_middle, restored

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return both()[0]


@pytest.fixture(scope="module")
def library():
    return both()[1]


@cache
def both():
    import sentencepiece

    return Vocabulary.from_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


# -- tokens ------------------------------------------------------------------

PARTS = st.one_of(st.text(max_size=30), st.text("aeinrst  ▁\n\t.,<>/s0123", max_size=60), st.sampled_from(["<s>", "</s>", "<unk>", "<0x0A>", "            ", "международный ", "naïve café ", "日本語", "🙂", "\u0000", "the international "]))


@given(st.lists(PARTS, max_size=8).map("".join))
@settings(max_examples=400, deadline=None)
def test_counts_equal_the_library(text):
    ours, theirs = both()
    assert ours.count(text) == len(theirs.encode(text))


def test_long_runs_and_long_texts(vocabulary, library):
    rng = random.Random(5)
    run = "".join(rng.choice("etaoinshrdlu") for _ in range(30_000))
    for text in (run, " " * 5000, run + "\n" + run, "word " * 300_000 + run, "é" * 3000, "\n" * 4000):
        assert vocabulary.count(text) == len(library.encode(text))


def test_ties_go_to_the_left_and_spaces_within_pieces_are_kept():
    same = Vocabulary({"a": -1.0, "b": -1.0, "aa": -2.0, "ab": -2.0}, lead=False)
    assert same.count("aaab") == 2 and same.count("aab") == 2 and same.count("aaa") == 2  # aa ab; aa b; aa a
    across = Vocabulary({"a": -3.0, "▁": -3.0, "a▁": -1.0, "a▁a": -2.0}, lead=False)
    assert across.count("a a a") == 2 and across.count("aé a") == 5


def test_token_counts_of_odd_rows(spark, library):
    rows = [(1, "hello world"), (1, "hello world"), (None, "x"), (2, None), (3, ""), (4, "a b\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("k", "b", "t", "n_bytes", "n_tokens")})
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, Vocabulary.from_model(MODEL), 10).collect()), key=str)
    want = sorted(((k, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 10) for k, t in rows), key=str)
    assert got == want
    assert token_counts(docs.where("false"), Vocabulary.from_model(MODEL), 10).collect() == []
    with pytest.raises(Exception):
        Vocabulary.from_model(str(public_tokenizers.path("byte_bpe_50k.json")))


# -- fill in the middle ------------------------------------------------------

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "char": r"(?s)."}


def plain_fim(key, text, unit):
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return key, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < 50 else "psm"
    return key, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,chunk", [("line", 4096), ("line", 3), ("line", 1), ("word", 5), ("char", 7)])
def test_fim_against_a_plain_version(spark, unit, chunk):
    rng = random.Random(1)
    texts = ["", None, "\n", "\n\n", "a", "a\n", "\na", "é\n漢字\n🙂", "has <P> in it\nx", "<S", "<", "P>\n<", "x\n" * 3000, "no line at all " * 500]
    texts += ["".join(rng.choice(" ab\né<PSM>") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [rng.choice(" a\n") + "".join(rng.choice("ab \n") for _ in range(rng.randrange(300))) for _ in range(50)]
    rows = [*enumerate(texts), (None, "null key\nhere"), (5, "a\n"), (5, "a\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "h", "t", "n", "form", "output")})
    made = fill_in_middle(docs, unit=unit, chunk=chunk).withColumn("restored", restored()).collect()
    got = [tuple(r)[:6] for r in made]
    assert sorted(got, key=str) == sorted((plain_fim(k, t, unit) for k, t in rows), key=str)
    assert sorted(r["restored"] for r in made) == sorted(t or "" for _, t in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in made}


def test_fim_rates_and_empty_table(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    assert {r["form"] for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle(docs, spm=100).collect()} == {"spm"}
    some = [r["form"] for r in fill_in_middle(docs, rate=40).collect()].count("plain")
    assert 140 < some < 220
    assert fill_in_middle(docs.where("false")).collect() == []


@given(st.lists(st.text("a\né", max_size=12), max_size=6), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_chunks_find_every_unit(texts, size):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    held = chunks_of(np.frombuffer(b"".join(raw), dtype=np.uint8), ends, "line", size)
    units = [re.findall(PATTERNS["line"], t) for t in texts]
    assert held.units().tolist() == list(map(len, units))
    for i, u in enumerate(units):
        places = np.cumsum([ends[i], *(len(x.encode()) for x in u)])
        assert held.position(np.full(len(places), i), np.arange(len(places))).tolist() == places.tolist()


# -- hard negatives ----------------------------------------------------------


def plain_negatives(rows, is_anchor, scale=256, positives=5, negatives=3, low=50, high=95):
    kept = []
    for number, (key, label, v) in enumerate(rows):
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(float(x) * scale) for x in v]
        if sum(x * x for x in w) <= 2**53:
            kept.append((number, key, label, w))
    out = []
    for number, key, label, w in kept:
        if not is_anchor(key):
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, x)), k, lab == label) for n, k, lab, x in kept if n != number)
        for ps, pid, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and -low * ps <= -100 * s[0] <= -high * ps][:negatives]
            out += [(key, pid, i + 1, s[1], -ps, -s[0]) for i, s in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("row", "id", "anchor", "vec", "norm", "score")})
    got = neg.hard_negatives(table, F.col("vec_id") % 5 == 0, **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def vectors(rng, n, dims=8, labels=3):
    # Float32 values, so that the plain version sees what the table holds.
    return [(i, int(rng.integers(labels)), [float(x) for x in (rng.normal(size=dims) * rng.choice([0.2, 1, 3])).astype(np.float32)]) for i in range(n)]


def test_negatives_against_all_pairs(spark, monkeypatch):
    rows = vectors(np.random.default_rng(2), 160)
    want = plain_negatives(rows, lambda k: k % 5 == 0)
    assert len(want) > 300 and found(spark, rows) == want
    # Many blocks of anchors give the same.
    monkeypatch.setattr(neg, "BLOCK_BYTES", 1500)
    assert found(spark, rows) == want
    assert found(spark, rows, positives=2, negatives=1, low=20, high=80) == plain_negatives(rows, lambda k: k % 5 == 0, positives=2, negatives=1, low=20, high=80)


def test_negatives_of_odd_rows(spark):
    rows = vectors(np.random.default_rng(4), 50)
    hot = rows[7][2]
    rows += [(100 + i, i % 3, hot) for i in range(60)]  # a third of all rows are one vector: ties go by key
    rows += [(100, 1, hot), (100, 1, hot), (5, 0, rows[5][2])]  # repeated rows and keys
    rows += [(200, None, hot), (None, 1, hot), (205, 1, None), (210, 1, [1.0, None]), (215, 1, [float("nan")] * 8), (220, 1, [float("inf")] * 8), (225, 2, []), (230, 2, hot[:3]), (235, 0, [1e30] * 8), (240, 0, [0.0] * 8)]
    assert found(spark, rows) == plain_negatives(rows, lambda k: k % 5 == 0)


def test_negatives_of_empty_tables(spark):
    rows = vectors(np.random.default_rng(6), 20)
    assert found(spark, rows[:0]) == []
    assert found(spark, [r for r in rows if r[0] % 5]) == []
    assert found(spark, [(i, 1, v) for i, _, v in rows]) == []


def test_buckets_are_passed_over():
    rng = np.random.default_rng(8)
    n, dims = 4000, 8
    v = rng.integers(-40, 40, (n, dims)) * np.repeat([8, 4, 2, 1], n // 4)[:, None]
    norm = np.sqrt((v**2).sum(axis=1).astype(float))
    order = np.argsort(-norm)
    columns = {"row": np.arange(n), "id": rng.permutation(n), "label": rng.integers(0, 2, n), "norm": norm[order]}
    batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns.values()), pa.array(v[order].tolist(), pa.list_(pa.int32()))], names=[*columns, "vec"])
    anchors = np.arange(0, n, 100)
    own = np.arange(len(anchors))
    found = neg.Searches(own, np.zeros_like(own), np.full(len(own), -np.inf), np.full(len(own), np.inf), anchors, columns["label"][anchors], norm[order][anchors], v[order][anchors].astype(float), True, 3)
    scores, ids, made = neg.bucket_search(found, iter([batch]), bucket=100)
    all_scores = (v[order][anchors] @ v[order].T).astype(float)
    all_scores[columns["label"][anchors][:, None] != columns["label"]] = -np.inf
    all_scores[own, anchors] = -np.inf
    best = np.lexsort((np.broadcast_to(columns["id"], all_scores.shape), -all_scores))[:, :3]
    assert (ids == columns["id"][best]).all() and (scores == np.take_along_axis(all_scores, best, 1)).all()
    assert made < 0.5 * len(own) * n / 100
