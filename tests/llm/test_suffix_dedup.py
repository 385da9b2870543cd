"""Operator 1 against a brute-force scan of all 50-byte strings."""

import hashlib
import random

import pytest

from statforge.llm.suffix_dedup import COVER, PERIOD, SPAN, dedup, op1_suffix_dedup

from .cases import EDGE_TEXTS, SCHEMA, edge_documents


def brute(rows):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - SPAN + 1):
            w = b[i : i + SPAN]
            first[w] = min(first.get(w, float("inf")), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - SPAN + 1):
            if first[b[i : i + SPAN]] < key(d):
                gone[i : i + SPAN] = b"\1" * SPAN
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_files(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op1_suffix_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé ") for _ in range(r.randint(0, 300))) for _ in range(12)]
    passage = "".join(r.choice("xyz ") for _ in range(73))
    texts = list(EDGE_TEXTS)
    for _ in range(60):
        t = r.choice(base)
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(t))
            t = t[:i] + r.choice(["", "q", passage, passage[:50], passage[:49], passage[10:], r.choice(base)[:80]]) + t[i + r.randint(0, 3) :]
        texts.append(t)
    docs = edge_documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id % 17 = 3").selectExpr("cast(null as long) doc_id", *docs.columns[1:])).unionByName(docs.filter("doc_id % 13 = 1"))
    rows = [tuple(x) for x in docs.select("doc_id", "text").collect()]
    assert got(dedup(docs)) == brute(rows)
    kept = dedup(docs, with_text=True)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_empty(spark):
    assert dedup(spark.createDataFrame([], SCHEMA)).count() == 0
