"""Operators on small frames."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import entities as ent
from quernstone.operators import keywords as kw
from quernstone.operators import profile as prof
from quernstone.operators import similarity as sim
from quernstone.operators.clustering import OUTLIERS, assign_topics, kmeans
from quernstone.operators.dedup import content_hash, drop_duplicates, first_per
from quernstone.operators.label import Decision, Models, label
from quernstone.operators.language import detect_language
from quernstone.providers import brain
from quernstone.providers.clients import FakeClient, WithFallback


def test_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None), (5, None)], "i int, t string")
    kept = drop_duplicates(df.where("t is not null"), content_hash("t"), "i")
    assert sorted(r["i"] for r in kept.collect()) == [1, 3]
    assert [r["i"] for r in first_per(df, ["t"], [F.desc("i")]).orderBy("i").collect()] == [2, 3, 5]


@pytest.mark.parametrize(
    ("dialogue", "code", "languages", "kind"),
    [(0.5, 0.5, 1, "chat_dataset"), (0.4, 0.31, 3, "technical_dataset"), (0.4, 0.3, 3, "multilingual_dataset"), (0.4, 0.3, 2, "mixed_dataset"), (0.0, 0.031, 5, "multilingual_dataset")],
)
def test_dataset_type(spark, dialogue, code, languages, kind):
    assert spark.range(1).select(prof.dataset_type(F.lit(dialogue), F.lit(code), F.lit(languages)).alias("k")).first()["k"] == kind


def test_profile_and_report(spark):
    rows = [("t1", "en", "User: hi!"), ("t1", "fr", "def f"), ("t2", "en", "plain"), ("t2", "en", None)]
    row = prof.dataset_profile(spark.createDataFrame(rows, "topic string, lang string, text string")).first()
    assert row["total_documents"] == 4 and row["cluster_sizes"] == {"t1": 2, "t2": 2} and row["language_distribution"] == {"en": 3, "fr": 1}
    assert row["dialogue_ratio"] == 0.3333 and row["code_ratio"] == 0.3333 and row["probable_dataset_type"] == "technical_dataset"
    assert row["avg_noise_ratio"] == round((2 / 9 + 0 + 0) / 3, 4)
    empty = spark.createDataFrame([], "topic string, lang string, text string")
    assert prof.dataset_profile(empty).first()["total_documents"] == 0
    stats = prof.ingestion_stats(spark.createDataFrame([("en", ".txt", 3, 2097152), ("fr", ".txt", 4, 0)], "lang string, format string, words int, size long")).first()
    assert (stats["languages"], stats["formats"], stats["avg_length"], stats["total_size_mb"]) == (["en", "fr"], [".txt"], 3, 2.0)


def test_language(spark):
    rows = [("the cat is on the mat and it was good",), ("le chat est dans la maison et il dort",), ("der Hund ist nicht im Haus und die Katze",), ("zzz",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(detect_language("t")).collect()] == ["en", "fr", "de", "unknown", "unknown", "unknown"]


def test_terms_and_keywords(spark):
    docs = spark.createDataFrame([(1, "apple banana apple " * 10), (2, "cherry banana date " * 10), (3, "short")], "doc_id long, text string")
    top = {(r["doc_id"], r["rank"]): r["term"] for r in kw.top_terms(docs, 2).collect()}
    assert top == {(1, 1): "apple", (1, 2): "banana", (2, 1): "cherry", (2, 2): "date"}
    assert docs.limit(1).select(kw.terms(F.lit("a bc de fg"), 3).alias("t")).first()["t"] == ["bc", "de", "fg", "a bc", "bc de", "de fg", "a bc de", "bc de fg"]
    found = {r["doc_id"]: r["key_words"] for r in kw.keywords(docs).collect()}
    assert found[3] == [] and 0 < len(found[1]) <= 10 and any("apple" in w for w in found[1])


def test_topics(spark):
    docs = spark.createDataFrame([(i, "n", ["car", "wheel"] if i % 2 else ["fish", "river"]) for i in range(8)] + [(9, "n", [])], "doc_id long, doc_name string, key_words array<string>")
    topics = {r["doc_id"]: r["topic"] for r in assign_topics(docs, k=2).collect()}
    assert topics[1] == topics[3] != topics[2] and topics[9] == OUTLIERS
    assert kw.top_topics(docs.withColumn("topic", F.lit("x"))).first()["topic"] == "insufficient_data"
    assert kmeans(docs.where("false").withColumn("v", F.array(F.lit(1.0))), "v").count() == 0


def test_intents_and_classes(spark):
    df = spark.createDataFrame([("I want to cancel my order",), ("Bonjour",), ("qqq zzz",), (" ",)], "text string")
    found = [r["intent"] for r in sim.detect_intent(df).collect()]
    assert [f["intent"] for f in found] == ["cancel_order", "greeting", "unknown", "unknown"]
    assert found[0]["confidence"] == 1.0 and found[3]["confidence"] == 0.0
    classes = [r["classification"] for r in sim.classify(df, ["This message is a greeting", "cancel_order"]).collect()]
    assert classes[0]["label"] == "cancel_order" and sum(classes[0]["all_scores"].values()) == pytest.approx(1, abs=1e-3)
    assert classes[3]["label"] == "This message is a greeting" and classes[3]["confidence"] == 0
    assert sim.classify(df, []).first()["classification"]["label"] == "unknown"
    assert sim.detect_domain(spark.createDataFrame([("patient diagnosis hospital",)], "text string")).first()["domain"] == "medical"


def test_ties_take_the_first_declared(spark):
    best = sim.best_exemplar("v", {"b": [[1.0, 0.0]], "a": [[1.0, 0.0]]})
    assert spark.sql("SELECT array(1d, 0d) v").select(best.alias("x")).first()["x"]["intent"] == "b"


def test_entities(spark):
    row = spark.createDataFrame([("Dr. Smith paid $12 to Acme Inc, dr. x, Dr. Smith, $12 at 10:30",), ("",)], "t string").select(ent.rule_entities("t").alias("e"))
    found = [[(e["label"], e["text"]) for e in r["e"]] for r in row.collect()]
    assert found == [[("MONEY", "$12"), ("TIME", "10:30"), ("ORG", "Acme Inc"), ("PERSON", "Dr. Smith")], []]
    check = lambda t, l: spark.range(1).select(ent.valid(F.lit(t), F.lit(l)).alias("v")).first()["v"]
    assert not check("veux", "ORG") and not check("123", "PERSON") and check("123", "DATE") and not check("x", "GPE") and not check("ab", "NOPE") and not check("١٢٣", "ORG")
    names = spark.range(1).select(ent.normalise_label(F.lit("B-PER")).alias("a"), ent.normalise_label(F.lit("LOC")).alias("b"), ent.description(F.lit("FAC")).alias("c")).first()
    assert tuple(names) == ("PERSON", "GPE", "FAC")


def test_labeller(spark):
    df = spark.createDataFrame([(i, f"I want a refund number {i}") for i in range(12)], "i int, text string")
    tasks = ("classification", "ner", "intent", "sentiment", "topic", "clustering")
    rows = label(df, Decision("qa", tasks, ("refund", "greeting")), Models(client=FakeClient())).collect()
    assert len(rows) == 12 and all(r["intent"]["intent"] == "refund_request" and r["qa_pairs"] and 0 <= r["confidence_score"] <= 1 for r in rows)
    only = label(df, Decision("translation", tasks)).columns
    assert "intent" not in only and "translation" in only
    assert label(df.where("false"), Decision("", tasks)).count() == 0
    design = {"dataset_type": "RAG", "tasks": ["NER"], "labeling_strategy": {"labels": ["a"]}}
    assert Decision.from_brain(design) == Decision("rag", ("ner",), ("a",))


class Broken:
    def generate(self, prompt, system=""):
        raise OSError("no network")


def test_clients_and_design(spark):
    assert WithFallback(Broken(), FakeClient("ok")).generate("x") == "ok"
    with pytest.raises(RuntimeError):
        WithFallback(Broken(), Broken()).generate("x")
    with pytest.raises(ValueError):
        WithFallback(Broken()).generate("x")
    with pytest.raises(ValueError):
        WithFallback(None).generate("x")
    profile = spark.sql("SELECT 3 total_documents, map('en', 3) language_distribution")
    good = '{"dataset_type":"qa","tasks":["qa"],"ideal_schema":{"q":"question"},"labeling_strategy":{"type":"x","labels":["a"]},"optimal_format":"jsonl"}'
    assert brain.design(spark, profile, FakeClient(f"Sure: {good} Done"))["tasks"] == ["qa"]
    for bad in ("no braces", '{"dataset_type": "x"}'):
        with pytest.raises(ValueError):
            brain.design(spark, profile, FakeClient(bad))
    assert "## Languages\n- en: 3" in brain.readme({"language_distribution": {"en": 3}, "total_documents": 3})


def test_duplicates_with_nulls_and_ties(spark):
    from quernstone.operators.dedup import drop_duplicates, mark_duplicates

    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), (None, 3, "n"), (None, 4, "m"), ("b", None, "o"), ("b", None, "p"), ("c", None, "q"), ("c", 9, "r")]
    df = spark.createDataFrame(rows, "digest string, place int, other string")
    kept = drop_duplicates(df, "digest", "place").collect()
    assert sorted((r["digest"] or "-", r["place"]) for r in kept if r["digest"] != "b") == [("-", 3), ("a", 1), ("c", 9)]
    assert sum(r["digest"] == "b" for r in kept) == 1 and mark_duplicates(df, "digest", "place").count() == len(rows)


def test_no_text_is_moved_to_find_duplicates(spark):
    from quernstone.plans.catalogue import QUERIES

    plan = QUERIES["exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("md5(")]
    assert "text" not in above


def test_term_counts(spark):
    from quernstone.operators.keywords import term_counts

    rows = spark.createDataFrame([("bb aa bb, aa. bb",), ("",), (None,), ("x",)], "text string").select(term_counts("text", 2).alias("t")).collect()
    assert [{(c["term"], c["tf"]) for c in r["t"]} for r in rows] == [{("aa", 2), ("bb", 3), ("bb aa", 2), ("aa bb", 2)}, set(), set(), set()]


def test_hot_terms_take_the_other_way(spark, monkeypatch):
    from quernstone.operators import keywords as kw

    docs = spark.createDataFrame([(i, f"common w{i} w{i % 7}") for i in range(3000)], "doc_id long, text string")
    want = {(r["doc_id"], r["term"], r["df"]) for r in kw.tf_idf(docs).collect()}
    monkeypatch.setattr(kw, "BROADCAST_TERMS", 1000)
    assert {(r["doc_id"], r["term"], r["df"]) for r in kw.tf_idf(docs).collect()} == want


def test_two_model_forms(monkeypatch):
    """Each client against a server that checks its form; the second answers when the first fails."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from quernstone.providers import clients

    seen = []

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers, body))
            fail = body["messages"][-1]["content"] == "fail" and self.path.endswith("completions")
            reply = {"choices": [{"message": {"content": "first"}}]} if self.path.endswith("completions") else {"content": [{"type": "text", "text": "second"}]}
            self.send_response(500 if fail else 200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setenv(clients.PRIMARY_KEY, "one")
    monkeypatch.setenv(clients.FALLBACK_KEY, "two")
    try:
        both = WithFallback(clients.HttpClient(url), clients.MessagesClient(url))
        assert (both.generate("hello", "be brief"), both.generate("fail", "be brief")) == ("first", "second")
    finally:
        server.shutdown()
    assert [path for path, _, _ in seen] == ["/chat/completions", "/chat/completions", "/messages"]
    assert seen[0][1]["Authorization"] == "Bearer one" and seen[0][2]["messages"][0] == {"role": "system", "content": "be brief"}
    assert seen[2][1]["x-api-key"] == "two" and seen[2][2]["system"] == "be brief" and seen[2][2]["max_tokens"] == clients.FALLBACK_TOKENS
    chosen = clients.default_client()
    assert chosen.primary.json_mode and chosen.fallback.model == clients.FALLBACK_MODEL
    monkeypatch.delenv(clients.PRIMARY_KEY)
    monkeypatch.delenv(clients.FALLBACK_KEY)
    with pytest.raises(ValueError, match="no model client"):
        clients.default_client().generate("x")


def test_member_blocks(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "IF(id < 90, 'big', 'small') AS topic")
    blocks = prof.member_blocks(docs, "topic", most=10).collect()
    assert sorted(i for r in blocks for i in r["doc_ids"]) == list(range(100)) and max(len(r["doc_ids"]) for r in blocks) < 40
    assert prof.member_blocks(docs.where("false"), "topic").count() == 0


def test_cosines_equal_the_expression_to_the_last_bit(spark):
    from quernstone.functions.vectors import cosine, cosines

    rows = [(i, [(i * 37 + j * 11) % 17 / 7 - 1 for j in range(5)]) for i in range(40)] + [(50, None), (51, [1.0]), (52, [None, 1.0, 1.0, 1.0, 1.0]), (53, [0.0] * 5), (54, [float("nan")] * 5), (55, [])]
    others = [[0.1, 0.7, -0.3, 0.2, 0.9], [0.0] * 5, [3.0, 1.0, 4.0, 1.0, 5.0]]
    both = spark.createDataFrame(rows, "k int, v array<double>").select(cosines("v", others).alias("a"), F.array(*[cosine("v", F.array(*map(F.lit, o))) for o in others]).alias("b"))
    assert all(repr(r["a"]) == repr(r["b"]) for r in both.collect())
    # Exemplars are no literals of the plan any more, which JVM expressions held one by one against each row.
    many = sim.best_exemplar("v", {"a": [[float(i)] * 300 for i in range(30)]})
    assert len(str(many._jc.toString())) < 5_000


def test_topics_and_clusters_are_learnt_once(spark, monkeypatch):
    from quernstone.operators import label as module

    calls = []
    monkeypatch.setattr(module, "kmeans", lambda df, *a, out, **b: calls.append(out) or df.withColumn(out, F.lit(1)))
    docs = spark.range(12).selectExpr("concat('text ', id) AS text")
    done = module.label(docs, module.Decision("", ("topic", "clustering")))
    assert calls == ["topic_id"] and done.where("topic_id <> cluster_id").count() == 0
    assert module.label(docs.limit(3), module.Decision("", ("topic", "clustering"))).where("topic_id is null and cluster_id = 1").count() == 3


def test_row_cosine_equals_the_expression(spark):
    from quernstone.functions.vectors import cosine, row_cosine

    v = [[(i * 37 + j * 11) % 17 / 7 - 1 for j in range(4)] for i in range(1100)]
    odd = [(None, v[0]), (v[0], None), ([1.0], v[0]), ([None, 1.0, 1.0, 1.0], v[0]), ([0.0] * 4, v[0]), ([], []), ([float("nan")] * 4, v[0]), ([2.0], [3.0])]
    rows = spark.createDataFrame([*zip(v, v[1:]), *odd], "a array<double>, b array<double>").select(row_cosine("a", "b").alias("x"), cosine("a", "b").alias("y"))
    assert all(repr(r["x"]) == repr(r["y"]) for r in rows.collect())


def test_texts_become_terms_once(spark, monkeypatch):
    """Whatever the number of terms, texts are read for them once; counts are those of term_counts()."""
    from quernstone.operators import keywords as kw

    texts = ["Some words, some more words and some again " * 4, "", None, "  ", "one other Text of words " * 6 + "ab ab", "a b c", "one other Text of words " * 6 + "ab ab"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: sorted(map(tuple, r["terms"])) for r in kw.counted_terms(docs, longest=2).collect()}
    assert got == {r["doc_id"]: sorted(map(tuple, r["t"])) for r in docs.select("doc_id", kw.term_counts("text", 2).alias("t")).collect()}
    want = sorted(map(tuple, kw.top_terms(docs, min_chars=20).collect()))
    monkeypatch.setattr(kw, "BROADCAST_TERMS", 2)
    made = []
    monkeypatch.setattr(kw, "terms", lambda *a, f=kw.terms: made.append(a) or f(*a))
    assert sorted(map(tuple, kw.top_terms(docs, min_chars=20).collect())) == want and len(made) == 1


def test_keywords_of_rows_that_repeat_a_key(spark, monkeypatch):
    """Each row is ranked by its own text, in whatever batches rows come, and nothing moves."""
    texts = ["green apples and red apples grow on old trees near the river bank. " * 2, "fast engines join large tables while small tables wait in memory. " * 2]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[0]), (2, "short"), (3, None), (4, "1 2 3 . " * 20)], "doc_id long, text string")
    alone = [kw.keywords(spark.createDataFrame([(0, x)], "doc_id long, text string")).first()["key_words"] for x in texts]
    assert all(len(w) > 2 for w in alone)
    want = sorted([("1", alone[0]), ("1", alone[1]), ("None", alone[0]), ("2", []), ("3", []), ("4", [])])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10000", "2"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            made = kw.keywords(docs.coalesce(1))
            assert sorted((str(r["doc_id"]), r["key_words"]) for r in made.collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
