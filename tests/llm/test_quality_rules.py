"""Operator 4 against its SQL, on files and on awkward rows."""

import pytest
from pyspark.sql import functions as F

from statforge.llm.quality_rules import OP4_SQL, ablation, apply_policy, keep_documents, ledger, op4_quality_rules

from .cases import EDGE_TEXTS, SCHEMA, edge_documents
from .oracle import duck, same_rows

MORE = ["a b c d e a b c d e", "a b c d e f " * 10, "x\nx\nx\ny\n \n", "### $$$ ***" * 5, "one two three four five six seven eight nine ten eleven"]


@pytest.mark.parametrize("from_files", [False, True])
def test_matches_sql(spark, from_files):
    if from_files:
        same_rows(op4_quality_rules(spark, "/root/testdata/sf0.001").toPandas(), duck("/root/testdata/sf0.001").execute(OP4_SQL).df())
    else:
        docs = edge_documents(spark, EDGE_TEXTS + MORE)
        same_rows(apply_policy(ledger(docs)).toPandas(), duck(documents=docs).execute(OP4_SQL).df())


def test_keep_and_ablate(spark):
    docs = edge_documents(spark, EDGE_TEXTS + MORE).withColumn("n_words", F.lit("clash"))
    rows = apply_policy(ledger(docs))
    kept = {r.doc_id for r in rows.filter("kept").collect()}
    out = keep_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert {r.n_words for r in out.collect()} == {"clash"}
    by_rule = {r.rule: r for r in ablation(rows).collect()}
    assert by_rule["few_words"].failed == rows.filter("n_words < 10").count()
    assert all(r.only_this <= r.failed for r in by_rule.values())


def test_empty(spark):
    assert apply_policy(ledger(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_plan(spark):
    plan = op4_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
