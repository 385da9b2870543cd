"""Columns of an input that have the names of working columns, in every stage and operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from .cases import EDGE_TEXTS, edge_documents

NAMES = ["_words", "_lines", "_hashes", "_sorted", "n_words", "_own_n_words", "_gone", "_", "_key", "_epoch", "_block", "epoch", "block", "key", "own", "home", "hash", "blocks", "weight", "component", "rep", "first", "bands", "n", "a.b", "with `tick"]


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:4]])
def test_stage_keeps_further_columns(spark, stage):
    docs = edge_documents(spark, [*EDGE_TEXTS, *EDGE_TEXTS[17:20]])
    plain = stage(spark, docs, None)
    more = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES])
    out = stage(spark, more, None)
    assert out.columns == more.columns
    rows = out.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect())
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)


def test_packing_ignores_further_columns(spark):
    docs = edge_documents(spark)
    more = docs.select("*", *[F.lit("x").alias(n) for n in NAMES])
    pieces = lambda d: sorted(tuple(r)[:5] for r in P.packing(spark, d, None).collect())
    assert pieces(more) == pieces(docs)
