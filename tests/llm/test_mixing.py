"""Operator 6 against its SQL, and its weights against their targets."""

import math

import pytest

from statforge.llm.mixing import OP6_SQL, mix, mix_documents, mixing_plan, op6_mixing

from .cases import EDGE_TEXTS, SCHEMA, edge_documents
from .oracle import duck, same_rows


def test_sql(spark):
    same_rows(op6_mixing(spark, "/root/testdata/sf0.001").toPandas(), duck("/root/testdata/sf0.001").execute(OP6_SQL).df())


def test_edges_sql(spark):
    docs = edge_documents(spark, EDGE_TEXTS)
    docs = docs.unionByName(docs.filter("doc_id < 14"))
    rows = mix(docs, mixing_plan(docs)).selectExpr("own.doc_id", "own.source", "epoch", "block")
    same_rows(rows.toPandas(), duck(documents=docs).execute(OP6_SQL).df())
    out = mix_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == set(range(len(EDGE_TEXTS)))


def sources(spark, sizes):
    return spark.createDataFrame([(i * 1000 + j, "w " * 10, f"s{i}") for i, n in enumerate(sizes) for j in range(n)], "doc_id long, text string, source string")


def test_targets(spark):
    docs = sources(spark, [600, 60, 30])
    plan = mixing_plan(docs, repetition=None, entropy=0.8).collect()
    w = [r.weight for r in plan]
    assert sum(w) == pytest.approx(1) and -sum(x * math.log(x) for x in w) == pytest.approx(0.8, abs=1e-9)
    counts = {r.source: r["count"] for r in mix_documents(docs, repetition=2.0).groupBy("source").count().collect()}
    assert counts["s0"] == 600 and 60 < counts["s1"] <= 120 and counts["s2"] == 60
    part = mix_documents(docs, repetition=2.0, budget=3000)
    assert 300 <= part.count() <= 303 and part.distinct().count() == part.count()


def test_entropy_beyond_reach(spark):
    docs = sources(spark, [50, 50])
    for entropy in (0.0, 5.0):
        assert {round(r.weight, 9) for r in mixing_plan(docs, repetition=None, entropy=entropy).collect()} == {0.5}


def test_empty(spark):
    assert mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
