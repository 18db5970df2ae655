"""The ten operators against brute-force versions, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import op03_nearjoin as near
from quernstone.llm import op04_pii as pii
from quernstone.llm import op10_decontaminate as leak
from quernstone.llm.components import components
from quernstone.llm.op01_mix import mix, mixture
from quernstone.llm.op02_dedup import exact_dedup, misra_gries
from quernstone.llm.op05_shard import feistel, place_rows, shard
from quernstone.llm.op06_extract import extract_main
from quernstone.llm.op07_lines import kept_lines, line_dedup
from quernstone.llm.op08_quality import quality
from quernstone.llm.op09_chat import chat_format, formatted, read_back
from quernstone.llm.wordhash import ngrams, text_blocks, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "id", "row", "number", "digest", "band", "copies", "shard", "bucket"]
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def frame(spark, texts, sources=None):
    """Documents with extra columns whose names operators might use themselves."""
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def rng_words(rng, n, vocabulary=400):
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    texts = [" ".join(rng_words(rng, int(n))) for n in rng.integers(3, 200, 60)]
    texts += [texts[0]] * 25 + [None, "", None, "", "!!! ..."]
    for base in (1, 2, 3):  # near copies
        for _ in range(8):
            w = texts[base].split()
            w[int(rng.integers(len(w)))] = "edited"
            texts.append(" ".join(w))
    return texts + ["word " * 30_000]


# -- words ------------------------------------------------------------------


def test_word_hashes_agree_with_a_plain_split():
    texts = ["the cat", "", "Été-cat  the!", "a", "x" * 3000, "cat"]
    lower = [t.lower() for t in texts]
    got = []
    for _, _, data, offsets in text_blocks(pa.array(lower), 8):
        w = words_of(data, offsets)
        got += [w.hashes[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    plain = [WORD.findall(t.encode()) for t in lower]
    assert [len(g) for g in got] == [len(p) for p in plain]
    by_word = defaultdict(set)
    for g, p in zip(got, plain):
        for h, word in zip(g, p):
            by_word[word].add(h)
    assert all(len(h) == 1 for h in by_word.values()) and len({next(iter(h)) for h in by_word.values()}) == len(by_word)
    joined = "".join(lower).encode()
    w = words_of(np.frombuffer(joined, dtype=np.uint8), np.cumsum([0, *[len(t.encode()) for t in lower]]))
    grams, at = ngrams(w, 2)
    assert len(grams) == sum(max(0, len(p) - 1) for p in plain)


# -- 1 mix ------------------------------------------------------------------


def brute_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, rest = set(order), {}, share * sum(sizes.values())
    while left:
        rate = rest / sum(w[s] for s in left)
        full = {s for s in left if rate * w[s] > most * sizes[s]}
        if not full:
            return target | {s: rate * w[s] for s in left}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        left -= full
    return target


def test_mix(spark, corpus):
    texts = corpus * 4
    rng = np.random.default_rng(1)
    sources = [None if i % 11 == 0 else f"s{min(4, int(rng.exponential(1.5)))}" for i in range(len(texts))]
    got = mixture(frame(spark, texts, sources), (3.0, 1.0, 2.0), 1.5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = brute_targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        assert abs(r["copies"] - targets[s] / sizes[s]) < 1
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 1.5 * largest[s] + 0.05 * targets[s]
    again = mixture(frame(spark, texts, sources).repartition(7), (3.0, 1.0, 2.0), 1.5).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}
    mixed = mix(frame(spark, texts, sources), (3.0, 1.0, 2.0), 1.5)
    copies = {r["doc_id"]: r["copies"] for r in got}
    assert mixed.columns == frame(spark, texts[:1]).columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})


# -- 2 exact dedup ----------------------------------------------------------


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_dedup(spark, corpus, counters):
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, corpus), counters=counters).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(corpus):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup_of_repeated_rows_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup(rows, counters=2).collect()
    assert sorted((r["text_sha256"][:4], r["group_size"]) for r in got if r["kept"]) == sorted([(hashlib.sha256(b"a").hexdigest()[:4], 3), (hashlib.sha256(b"b").hexdigest()[:4], 2)])


def test_misra_gries_bounds():
    import pandas as pd

    rng = np.random.default_rng(0)
    stream = np.concatenate([np.zeros(500, dtype=int), rng.integers(1, 5000, 1500)])
    rng.shuffle(stream)
    counts = {}
    for part in np.array_split(stream, 20):
        counts = misra_gries(counts, pd.Series(part).value_counts(), 10)
    assert len(counts) <= 10 and 500 - 2000 / 11 <= counts[0] <= 500


# -- 3 near join ------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").lower().encode())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_near(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(find(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize(("bucket", "far", "block", "depth"), [(256, 2048, 128, 6), (6, 2, 3, 3), (2, 1, 3, 3), (3, 100, 3, 3)])
def test_near_join(spark, corpus, monkeypatch, bucket, far, block, depth):
    monkeypatch.setattr(near, "FAR", far)
    monkeypatch.setattr(near, "MAX_DEPTH", depth)
    monkeypatch.setattr(near, "BUCKET", bucket)
    monkeypatch.setattr(near, "BLOCK", block)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in near.near_join(frame(spark, corpus)).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_near(corpus)


def test_near_join_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        w = rng_words(rng, 120, 100_000)
        texts.append(" ".join(w))
        for at in rng.choice(115, 2, replace=False):
            w[at] = "x"
        texts.append(" ".join(w))
    truth = brute_near(texts)
    got = {r["doc_id"]: r["links"] for r in near.near_join(frame(spark, texts)).collect()}
    linked = [i for i, (_, n) in enumerate(truth) if n]
    assert len(linked) > 60 and sum(got[i] >= truth[i][1] for i in linked) >= 0.97 * len(linked)
    assert all(got[i] <= truth[i][1] for i in range(len(texts)))


def test_recall_is_what_trees_give():
    """Samples that agree as often as the similarity says, walked through the trees."""
    rng = np.random.default_rng(11)
    for depth, runs in ((2, 3), (4, 5)):
        n, found = 1500, 0
        a = rng.integers(0, 1 << 32, (n, near.COORDS), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
        met = np.zeros(n, dtype=bool)
        for run in range(runs):
            nodes = []
            for samples in (a, b):
                row, path = np.arange(n), np.full(n, near.mix64(np.array([run + 1], dtype=np.uint64))[0])
                for _ in range(depth):
                    row, path = near._choose(row, path, samples, 0.8)
                nodes.append(set(zip(row.tolist(), path.tolist())))
            for row, _ in nodes[0] & nodes[1]:
                met[row] = True
        found = (met & ((a == b).mean(axis=1) >= near.LOOSE)).mean()
        assert abs(found - near.recall(0.8, runs, depth)) < 0.03
    assert near.recall(0.8, near.runs_for(near.MAX_DEPTH), near.MAX_DEPTH) >= near.RECALL > near.recall(0.8, near.runs_for(near.START_DEPTH) - 1, near.START_DEPTH)


def test_templates_are_not_compared(spark, monkeypatch):
    """Documents that share half of a template are no near copies, and no large group of them is compared."""
    rng = np.random.default_rng(12)
    template = " ".join(f"t{i}" for i in range(120))
    texts = [f"{template} {' '.join(rng_words(rng, 75, 10**6))}" for _ in range(1500)]
    seen = []
    counted = near._counted
    monkeypatch.setattr(near, "_counted", lambda pairs, threshold: (seen.append(pairs.count()), counted(pairs, threshold))[1])
    got = near.near_join(frame(spark, texts)).collect()
    assert seen == [0] and all(r["links"] == 0 and r["class_id"] == r["doc_id"] for r in got)


def test_near_join_of_text_keys(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "One, two three four five six!"), (None, "x"), ("c", None), ("c", "")], "doc_id string, text string")
    got = sorted((r["doc_id"] or "-", r["class_id"], r["links"]) for r in near.near_join(docs).collect())
    assert got == [("-", None, 0), ("a", "a", 1), ("b", "a", 1), ("c", "c", 1), ("c", "c", 1)]
    assert sorted(r["doc_id"] or "-" for r in near.keep_one(docs).collect()) == ["-", "a", "c", "c"]


def test_keep_one(spark, corpus):
    kept = sorted(r["doc_id"] for r in near.keep_one(frame(spark, corpus)).collect())
    assert kept == sorted({c for c, _ in brute_near(corpus)})


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


# -- 5 sharding -------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    assert sorted(r[0] for r in spark.range(n).select(feistel(F.col("id"), n, 5)).collect()) == list(range(n))


def test_shards(spark, corpus):
    texts = corpus * 3
    got = shard(frame(spark, texts), 24).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard(frame(spark, texts).repartition(5), 24).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    placed = place_rows(frame(spark, texts), 24)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in placed.collect()} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    twins = spark.createDataFrame([(None, "a")] * 50, "doc_id long, text string")
    assert sorted((r["shard"], r["slot"]) for r in shard(twins, 7).collect()) == sorted((i % 7, i // 7) for i in range(50))


# -- 7 lines ----------------------------------------------------------------


def brute_lines(texts, min_docs, min_chars, keep_first):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    split = [(t or "").split("\n") for t in texts]
    df = Counter(k for lines in split for k in {key(x) for x in lines} if len(k) >= min_chars)
    bad, seen, out = {k for k, n in df.items() if n >= min_docs}, set(), []
    for lines in split:
        kept = []
        for x in lines:
            k = key(x)
            if k not in bad or keep_first and k not in seen:
                kept.append(x)
            seen.add(k)
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("min_docs", "min_chars", "partitions"), [(2, 1, 2), (10, 1, 16), (3, 4, 40)])
def test_line_dedup(spark, keep_first, min_docs, min_chars, partitions):
    rng = np.random.default_rng(min_docs)
    texts = ["\n".join(f" L{x}\t" if rng.random() < 0.5 else f"l{x}" for x in np.minimum(rng.geometric(0.05, int(n)), 60)) for n in rng.integers(0, 12, 150)]
    texts += [None, "", "\n\n", "É", "é", "common\n" * 5] + [f"common\nx{i}" for i in range(200)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(frame(spark, texts), min_docs, min_chars, keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, min_docs, min_chars, keep_first)


def test_line_dedup_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "a"), (1, "a\nc")], "doc_id long, text string")
    got = line_dedup(rows, 3, with_text=True).collect()
    assert sorted(r["text"] for r in got) == ["", "b", "b", "c"]
    assert kept_lines(b"x", None) == ([b"x"], 1, 0)


# -- 8 quality --------------------------------------------------------------


def test_quality(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"good{i}" for i in range(200)], [f"spam{i}" for i in range(200)]
    texts = [" ".join(rng.choice(good if i % 3 else bad, 40)) for i in range(600)] + [None, "", "word " * 20_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(9999, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r["doc_id"], r["score"]) for r in quality(docs, flipped).collect()} == {(r["doc_id"], r["score"]) for r in got}
    assert {r["score"] for r in quality(docs, labels.where("false")).collect()} == {0.5}


# -- 9 chat -----------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 1, "user", "hi ### \\ </turn> \\b):"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (2, 1, "assistant", "x"), (2, 2, "odd): role", None), (3, 1, "system", ""), (3, 2, "user", "####\n</turn></turn>\n\\\\h"), (4, 1, "system", "s"), (None, None, None, None)]
    chats = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("out", formatted(F.col("segments")))
    got = {r["conv_id"]: r for r in chats.withColumn("back", read_back(F.col("out"))).collect()}
    for c in (1, 2, 3, 4):
        assert [tuple(t) for t in got[c]["back"]] == [(r[2], r[3] or "") for r in rows if r[0] == c]
    assert {c: got[c]["fault"] for c in got} == {1: None, 2: 1, 3: None, 4: 2, None: 1}
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["\\b\\h Assistant: \\t ok"]
    assert "".join(s["text"] for s in got[1]["segments"]) == got[1]["out"]


# -- 10 decontamination -----------------------------------------------------


def plain_alignment(item, window):
    best, row = 0.0, [0.0] * (len(window) + 1)
    for a in item:
        new = [0.0]
        for j, b in enumerate(window):
            new.append(max(0.0, row[j] + (leak.MATCH if a == b else leak.MISMATCH), row[j + 1] + leak.GAP, new[j] + leak.GAP))
        row = new
        best = max(best, *row)
    return best


def test_alignment_agrees_with_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 30).astype(np.uint64)
        assert leak.local_alignment(a, b)[0] == plain_alignment(a, b)


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_contaminated(spark, monkeypatch, block):
    monkeypatch.setattr(leak, "BLOCK_BYTES", block)
    rng = np.random.default_rng(4)
    items = [rng_words(rng, 30, 5000) for _ in range(12)]
    texts, truth = [], set()
    for i in range(150):
        w = rng_words(rng, 150, 5000)
        if i % 3 == 0:
            k = 0 if i % 2 else int(rng.integers(len(items)))  # item 0 leaks often
            copy = list(items[k])
            for at in rng.choice(30, 4, replace=False):
                copy[at] = "edited"
            del copy[int(rng.integers(30))]
            at = int(rng.integers(150))
            w[at:at] = copy
            truth.add((i, k))
        texts.append(" ".join(w).upper() if i % 5 == 0 else ", ".join(w))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in leak.contaminated(frame(spark, [*texts, None, ""]), benchmark).collect()}
    assert set(got) == truth and all(0.5 <= s <= 1 for s in got.values())
    kept = {r["doc_id"] for r in leak.decontaminate(frame(spark, texts), benchmark).collect()}
    assert kept == set(range(150)) - {d for d, _ in truth}
    assert leak.contaminated(frame(spark, texts[:3]), benchmark.where("false")).count() == 0


@pytest.mark.parametrize("pairs", [1 << 22, 50])
def test_contaminated_finds_what_alignment_finds(spark, monkeypatch, pairs):
    """Single copies with many edits: evenly replaced words, random ones, insertions that break every 3-gram, halves."""
    monkeypatch.setattr(leak, "_PAIRS", pairs, raising=False)
    rng = np.random.default_rng(8)
    items = [rng_words(rng, int(n), 3000) for n in rng.integers(15, 40, 30)]
    items[0] = rng_words(rng, 20, 3000)
    texts = []
    for k, item in enumerate(items):
        copy = list(item)
        if k == 0 or k % 5 == 4:
            copy[3::4] = ["edited"] * len(copy[3::4])
        elif k % 5 == 1:
            for at in rng.choice(len(copy), int(len(copy) * rng.uniform(0.2, 0.3)), replace=False):
                copy[at] = rng_words(rng, 1, 3000)[0]
        elif k % 5 == 2:
            copy = [x for i, w in enumerate(copy) for x in ([w, "more"] if i % 2 else [w])]
        elif k % 5 == 3:
            copy = copy[: -(-len(copy) // 2)]
        else:
            del copy[2::3]
        w = rng_words(rng, 120, 3000)
        at = int(rng.integers(120))
        texts.append([*w[:at], *copy, *w[at:]])
    truth = {(d, k): s for d, t in enumerate(texts) for k, x in enumerate(items) if (s := plain_alignment(x, t) / (leak.MATCH * len(x))) >= 0.5}
    assert {(k, k) for k in range(30)} <= set(truth)
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in leak.contaminated(frame(spark, [" ".join(t) for t in texts]), benchmark).collect()}
    assert got == truth


# -- all --------------------------------------------------------------------


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        mixture(docs, (1.0,)),
        mix(docs, (1.0,)),
        exact_dedup(docs),
        near.near_join(docs),
        near.keep_one(docs),
        pii.pseudonymise(docs, "k"),
        shard(docs, 3),
        place_rows(docs, 3),
        extract_main(pages),
        line_dedup(docs),
        quality(docs, labels),
        chat_format(chats),
        leak.contaminated(docs, benchmark),
        leak.decontaminate(docs, benchmark),
    ):
        assert made.collect() == []
