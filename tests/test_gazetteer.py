"""Names found by the automaton against a search for each name at each place."""

import random

from pyspark.sql import functions as F

from quernstone.operators.gazetteer import find_names

NAMES = [("United States", "GPE"), ("States", "LOC"), ("iran", "GPE"), ("Iran", "NORP"), ("İstanbul", "GPE"), ("Côte d'Ivoire", "GPE"), ("a", "ORG"), ("a b", "PRODUCT"), ("", "GPE"), (None, "GPE"), ("nolabel", None), ("U.S.", "GPE")]


def lower(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def plain(text):
    found = []
    text = text or ""
    word = lambda c: c.isalnum() or c == "_"
    for name, label in {(lower(n), x) for n, x in NAMES if n and x}:
        for i in range(len(text) - len(name) + 1):
            j = i + len(name)
            if lower(text)[i:j] == name and not (i and word(text[i - 1]) and word(text[i])) and not (j < len(text) and word(text[j]) and word(text[j - 1])):
                found.append((text[i:j], label, i, j))
    return found


def test_names_against_a_plain_search(spark):
    rng = random.Random(3)
    texts = ["The UNITED STATES, Iran and iranian.", "İstanbul istanbul İSTANBUL", "côte D'IVOIRE", "U.S. and U.S.A.", "", None, "states_ states-x", "a b a"]
    texts += [" ".join(rng.choice(["a", "b", "ab", "States", "united", "U.S.", "iran", "É"]) for _ in range(rng.randrange(40))) for _ in range(80)]
    rows = [*enumerate(texts), (0, texts[0]), (None, "iran")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "found", "label")})
    names = spark.createDataFrame([*NAMES, NAMES[0]], "name string, label string")
    want = sorted(((k, *f) for k, t in rows for f in plain(t)), key=str)
    for block_bytes in (1 << 20, 8):  # one automaton, and several
        got = find_names(docs, names, block_bytes=block_bytes).collect()
        assert sorted(((r["doc_id"], r["text"], r["label"], r["start"], r["end"]) for r in got), key=str) == want
    assert {r["description"] for r in got if r["label"] == "LOC"} == {"Geographic location"}
    assert find_names(docs, names.where("false")).collect() == [] and find_names(docs.where("false"), names).collect() == []
