"""Expressions, with expected values worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import text as x
from quernstone.functions.confidence import confidence, needs_review
from quernstone.functions.vectors import cosine, dot


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression("v").alias("r")).first()["r"]


@pytest.mark.parametrize(("n", "quality"), [(0, 0.0), (1, 0.35), (3, 0.55), (10, 0.75), (50, 0.90), (51, 0.95)])
def test_text_quality_by_number_of_words(spark, n, quality):
    assert one(spark, "w " * n, x.text_quality) == quality


def test_text_quality_of_null(spark):
    assert one(spark, None, x.text_quality) == 0.0


@pytest.mark.parametrize(
    ("label", "clean"),
    [("This message is a greeting", "greeting"), ("cancel_order", "cancel order"), ("request to refund", "refund"), ("  A_b ", "a b"), ("this is a request to x", "request to x")],
)
def test_clean_label(spark, label, clean):
    assert one(spark, label, x.clean_label) == clean


def test_words_and_chunks(spark):
    text = " a  b\nc\td e "
    assert one(spark, text, x.words) == ["a", "b", "c", "d", "e"]
    assert one(spark, text, x.word_count) == 5
    assert one(spark, text, lambda v: x.chunks(v, 2)) == ["a b", "c d", "e"]
    assert one(spark, "", lambda v: x.chunks(v, 2)) == []
    assert one(spark, "a b a", x.lexical_diversity) == pytest.approx(2 / 3)
    assert one(spark, " ", x.lexical_diversity) == 0


def test_noise_and_structure(spark):
    assert one(spark, "", x.noise_ratio) == 0
    assert one(spark, "aé!1 ", x.noise_ratio) == pytest.approx(2 / 5)
    assert one(spark, "x\nUser: hi", x.has_dialogue) is True
    assert one(spark, "my User: hi", x.has_dialogue) is False
    assert one(spark, "a class of fixed things", x.has_code) is True
    assert one(spark, "plain prose", x.has_code) is False


def test_stars_json_and_paths(spark):
    assert [one(spark, f"{i} stars", x.star_sentiment) for i in range(1, 6)] == ["negative", "negative", "neutral", "positive", "positive"]
    assert one(spark, 'x {"a":{"b":1}} y', x.outer_json) == '{"a":{"b":1}}'
    assert one(spark, "none", x.outer_json) is None
    assert one(spark, "file:/a.b/c.tar.GZ", x.extension) == ".gz"
    assert one(spark, "file:/a.b/c.tar.GZ", x.file_stem) == "c.tar"
    assert one(spark, "/d/.hidden", x.extension) == ""


def scored(spark, text="a b c", **signals):
    frame = spark.createDataFrame([(text,)], "t string")
    row = frame.select(confidence("t", **signals).alias("s")).select("s", needs_review("s").alias("r")).first()
    return row["s"], row["r"]


def test_confidence_by_hand(spark):
    assert scored(spark) == (0.22, True)
    assert scored(spark, entities=F.lit(0)) == (0.5075, False)
    assert scored(spark, intent=F.lit(0.5), intent_name=F.lit("unknown")) == (0.3375, True)
    assert scored(spark, generated={"translation": F.lit("x" * 20)}) == (0.22, True)
    assert scored(spark, generated={"translation": F.lit("x" * 21)}) == (round(0.8 * 0.85 + 0.55 * 0.15, 4), False)
    both = (0.9 * 0.3 + 0.65 * 0.05) / 0.35 * 0.85 + 0.55 * 0.15
    assert scored(spark, classification=F.lit(0.9), cluster=F.lit(3)) == (pytest.approx(both, abs=1e-4), False)
    assert scored(spark, classification=F.lit(None).cast("double")) == (0.22, True)


@settings(max_examples=15, deadline=None)
@given(c=st.floats(0, 1), s=st.floats(0, 1), n=st.integers(0, 30), text=st.text(max_size=60))
def test_confidence_is_a_share(spark, c, s, n, text):
    score, _ = scored(spark, text, classification=F.lit(c), sentiment=F.lit(s), entities=F.lit(n), topic=F.lit(1))
    assert 0 <= score <= 1


def test_vectors(spark):
    row = spark.sql("SELECT array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z").select(dot("a", "b").alias("d"), cosine("a", "b").alias("c"), cosine("a", "z").alias("n")).first()
    assert (row["d"], row["c"], row["n"]) == (1.0, pytest.approx(0.5**0.5), 0.0)
