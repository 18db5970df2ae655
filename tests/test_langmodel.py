"""The learnt language model on odd rows and more languages; its numbers are compared with SQL in test_catalogue."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quernstone.operators import langmodel

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the hen",
    "fr": "le petit chat est sur la table et la souris est dessous",
    "de": "der schnelle braune fuchs springt über den faulen hund und schläft",
    "es": "el perro come y la niña duerme en la casa de su abuela",
    "ru": "быстрая лиса прыгает через ленивую собаку и спит",
    "ar": "القط على الطاولة والكلب تحت الكرسي",
}


def plain_log(text, known):
    """Mean logarithm of a text for one language, known being its training texts."""
    clean = lambda s: " " + " ".join("".join(c if c.isalpha() else " " for c in s.lower()).split()) + " "
    grams = [clean(k)[i : i + 3] for k in known for i in range(len(clean(k)) - 2)]
    three = Counter(grams)
    two = Counter(g[1:] for g in grams)
    one = Counter(g[2] for g in grams)

    def p(g):
        r = (one[g[2]] + 1) / (sum(one.values()) + len(one) + 1)
        for table, at in ((two, g[1:]), (three, g)):
            same = [n for x, n in table.items() if x[:-1] == at[:-1]]
            if same:
                r = (table[at] + len(same) * r) / (sum(same) + len(same))
        return r

    asked = [clean(text)[i : i + 3] for i in range(len(clean(text)) - 2)]
    return sum(math.log(p(g)) for g in asked) / len(asked)


def test_model_against_a_plain_one(spark):
    known = spark.createDataFrame([(n, s) for n, s in SAMPLES.items()] + [(None, "not learnt"), ("xx", None), ("xx", "123")], "lang string, text string")
    model = langmodel.train(known)
    assert model.languages == sorted(SAMPLES)
    asked = ["the hen", "la souris est", "schläft der hund", "qqq zzz", "собаку", "والكلب", "la"]
    rows = langmodel.detect(spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "id long, text string"), model).collect()
    for r in rows:
        logs = {n: plain_log(r["text"], [s]) for n, s in SAMPLES.items()}
        assert r["detected_log"] == pytest.approx(max(logs.values()), abs=1e-9) and logs[r["detected"]] == pytest.approx(max(logs.values()), abs=1e-9)


def test_odd_rows(spark):
    model = langmodel.train(spark.createDataFrame([("a", "aaa aab"), ("b", "bbb bba")], "lang string, text string"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "aa"), (4, "aa"), (None, "bb " * 50_000)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("gram", "id", "row", "n")})
    got = sorted(((r["doc_id"] or 0, r["detected"]) for r in langmodel.detect(docs, model).collect()))
    assert got == [(0, "b"), (1, "unknown"), (2, "unknown"), (3, "unknown"), (4, "a"), (4, "a")]
    none = langmodel.train(docs.where("false").withColumn("lang", F.lit("x")))
    assert {r["detected"] for r in langmodel.detect(docs, none).collect()} == {"unknown"}
    with pytest.raises(ValueError):
        langmodel.detect(docs.withColumn("detected", F.lit(1)), model)


def test_looked_up_equals_joined(spark, monkeypatch):
    texts = ["Die Katze läuft über das Dach", "the cat runs over the roof", "le chat court sur le toit", "zq\U0001d400x ñandú 12 \u0130b", "x", "", None, "  ", "ab " * 40]
    docs = spark.createDataFrame([(i % 7, t, ("de", "en", "fr")[i % 3] if i < 3 else None) for i, t in enumerate(texts * 2)], "id int, text string, lang string")
    monkeypatch.setattr(langmodel, "LETTERS", 7)  # pieces end within words and texts
    model = langmodel.train(docs)
    rows = lambda df: sorted((r["id"], r["text"] or "", r["detected"], round(r["detected_log"] or 0, 9)) for r in df.collect())
    looked_up = rows(langmodel.detect(docs, model))
    monkeypatch.setattr(langmodel, "BROADCAST_GRAMS", 0)
    assert looked_up == rows(langmodel.detect(docs, model)) and len(looked_up) == 18 and [r[2] for r in looked_up].count("unknown") == 6


def test_letters_are_looked_up_without_a_row_each(spark):
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "die katze", "de")], "id int, text string, lang string")
    plan = langmodel.detect(docs, langmodel.train(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
