"""Answers that stay: no prompt is asked twice, whatever stopped the job."""

import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernstone.operators.label import Decision, Models, label
from quernstone.providers.answers import answered, ask, stored
from quernstone.providers.clients import render


def noting(log, fails="\0", ends="\0"):
    """A client that writes each call to a file; it fails for prompts with one text and stops the task at another. Local, so that it travels by value."""

    class Noted:
        def generate(self, prompt, system=""):
            with open(log, "a") as f:
                f.write(f"{time.time()} {prompt!r}\n")
            if ends in prompt:
                raise KeyboardInterrupt("stopped")
            if fails in prompt:
                raise OSError("no line")
            return prompt[::-1]

    return Noted()


def calls(log):
    return Counter(line.split(" ", 1)[1] for line in Path(log).read_text().splitlines()) if Path(log).exists() else Counter()


def texts(spark, n=40):
    return spark.createDataFrame([(i, f"text {i % n}", "x", "y") for i in range(2 * n)] + [(None, None, "x", "y"), (None, "", "x", "y")], "doc_id long, text string, sha string, answer string")


FAST = {"parallel": 3, "wait": 0.01}


def test_each_prompt_once_and_never_again(spark, tmp_path):
    log, store = str(tmp_path / "log"), f"file://{tmp_path}/store"
    for _ in range(2):
        rows = answered(texts(spark), "resume", noting(log), store, out="summary", **FAST).collect()
        assert len(rows) == 82 and all(r["summary"] == render("resume", r["text"] or "")[::-1] and r["summary_error"] is None and r["sha"] == "x" for r in rows)
        assert len(calls(log)) == 41 and set(calls(log).values()) == {1}
    # More rows: only the new prompts; another model or task: all.
    answered(texts(spark, 45), "resume", noting(log), store, out="summary", **FAST).count()
    assert len(calls(log)) == 46 and set(calls(log).values()) == {1}
    answered(texts(spark, 45), "resume", noting(log), store, model="other", out="summary", **FAST).count()
    assert set(calls(log).values()) == {2}
    with pytest.raises(ValueError):
        answered(texts(spark), "resume", noting(log), store, out="answer")


def test_a_stopped_job_goes_on(spark, tmp_path):
    log, store = str(tmp_path / "log"), f"file://{tmp_path}/store"
    with pytest.raises(Exception):
        answered(texts(spark), "resume", noting(log, ends="text 17"), store, out="summary", each=1000, **FAST).count()
    before = calls(log)
    kept = stored(spark, store).count()
    assert 0 < kept == len([p for p in before if "text 17" not in p])
    rows = answered(texts(spark), "resume", noting(log), store, out="summary", **FAST).collect()
    assert all(r["summary"] for r in rows)
    after = calls(log)
    assert len(after) == 41 and {p for p, n in (after - before).items() if p in before} == {p for p in before if "text 17" in p}


def test_errors_are_kept_and_tried_again(spark, tmp_path):
    log, store = str(tmp_path / "log"), f"file://{tmp_path}/store"
    rows = answered(texts(spark), "resume", noting(log, fails="text 3"), store, out="summary", tries=2, **FAST).collect()
    assert {r["summary_error"] for r in rows if "text 3" in (r["text"] or "")} == {"OSError: no line"}
    assert all(r["summary"] for r in rows if "text 3" not in (r["text"] or ""))
    assert {n for p, n in calls(log).items() if "text 3" in p} == {2}
    rows = answered(texts(spark), "resume", noting(log), store, out="summary", **FAST).collect()
    assert all(r["summary"] and r["summary_error"] is None for r in rows)
    assert {n for p, n in calls(log).items() if "text 3" in p} == {3} and stored(spark, store).count() == 41


def test_limit_of_calls(spark, tmp_path):
    log = str(tmp_path / "log")
    prompts = spark.range(24).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.col("id").cast("string").alias("prompt"))
    assert ask(prompts, noting(log), f"file://{tmp_path}/store", parallel=2, calls_a_second=16) == 24
    times = sorted(float(line.split(" ")[0]) for line in Path(log).read_text().splitlines())
    assert all(len([x for x in times if t <= x < t + 1]) <= 16 + 2 for t in times)
    assert ask(prompts, noting(log), f"file://{tmp_path}/store") == 0 and ask(prompts.where("false"), noting(log), f"file://{tmp_path}/new") == 0


def test_labelling_with_a_store(spark, tmp_path):
    log, store = str(tmp_path / "log"), f"file://{tmp_path}/store"
    docs = texts(spark).select("doc_id", "text")
    for _ in range(2):
        done = label(docs, Decision("resume"), Models(client=noting(log), store=store, model="m"))
        assert done.where("summary_error IS NULL AND summary IS NOT NULL AND confidence_score IS NOT NULL").count() == 82
    assert len(calls(log)) == 41 and set(calls(log).values()) == {1}
