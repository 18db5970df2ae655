"""Registered queries against their SQL, and the pipeline against its stages' rules, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from test_ops import brute_near

import corpus_pipeline
from quernstone.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(repr, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(c.execute(ORACLE_SQL[name]).df())


def test_near_join_of_documents(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in QUERIES["op3_nearjoin"](spark, DATA).collect()}
    assert [got[i] for i, _ in docs] == [(docs[c][0], n) for c, n in brute_near([t for _, t in docs])]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, DATA)
        assert made.columns == (columns if k < 4 else [*columns, "shard", "slot"])
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert set(seen[-1].items()) <= set(seen[-2].items())
    ids = sorted(seen[1])
    classes = brute_near([seen[1][i] for i in ids])
    assert sorted(seen[2]) == sorted({ids[c] for c, _ in classes})
    items = [r["text"].lower() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(x in t.lower() for t in seen[3].values() for x in items)
    assert set(seen[2]) - set(seen[3]) == {i for i, t in seen[2].items() if any(x in t.lower() for x in items)}
    placed = docs.collect()
    slots = {}
    for r in placed:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in placed)
