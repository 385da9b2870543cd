"""Operator 8: exact neighbours, held-out accuracy, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from statforge.llm.toxicity import NEIGHBOURS, BlockMaxIndex, isotonic, op8_toxicity, score_documents

from .cases import SCHEMA, edge_documents


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < np.linspace(0.02, 0.5, 40))
    dense = dense[dense.any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    idf = rng.random(40) + 0.5
    index = BlockMaxIndex([(np.flatnonzero(r), r[r > 0]) for r in dense], idf, block=16)
    words = rng.integers(0, 40, (50, 6))
    s, kth = index.cosines(words.reshape(-1), np.repeat(np.arange(50), 6), 50, 10)
    want = np.array([(dense[:, w] * idf[w]).sum(axis=1) for w in words])[:, index.order]
    assert np.allclose(kth, np.sort(want, axis=1)[:, -10], atol=1e-5)
    for got, w in zip(s[:, : len(dense)], want, strict=True):
        seen = np.isfinite(got)
        assert np.allclose(got[seen], w[seen], atol=1e-5)
        assert not (w[~seen] > np.sort(w)[-10] + 1e-5).any()


def brute_scores(docs, labels, k=NEIGHBOURS):
    """Every window against every example, in plain sums."""
    toxic = {}
    for d, y in labels:
        toxic[d] = max(y, toxic.get(d, 0))
    train = [(d, t, toxic[d]) for d, t in sorted(docs) if d in toxic and zlib.crc32(str(d).encode()) % 5]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    terms = lambda own: [*own, *[w[:4] + "^" for w in own if len(w) > 4]]
    known = {w for _, t, _ in train for w in terms(words(t))}
    df = Counter(w for _, t in docs for w in set(terms(words(t))) & known)
    idf = {w: math.log((1 + len(docs)) / (1 + df[w])) + 1 for w in known}
    examples = []
    for d, t, y in train:
        v = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(terms(words(t))).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        examples.append((d, y, {w: x / size for w, x in v.items()}))
    have = Counter(y for _, y, _ in examples)
    every = Counter(y for d, y in toxic.items() if zlib.crc32(str(d).encode()) % 5)
    mass = {y: every[y] / have[y] for y in have}
    k = min(k, len(examples))

    def share(text, own=None):
        own_words, shares = words(text), []
        for a in range(0, len(own_words), 12):
            window = Counter(w for w in terms(own_words[a : a + 12]) if w in known)
            if not window:
                continue
            c = sorted(((sum(n * idf[w] * v.get(w, 0) for w, n in window.items()), y) for d, y, v in examples if d != own), reverse=True)
            kth = c[min(k, len(c)) - 1][0]
            near = [(x, y) for x, y in c if x > 1e-9 and x >= kth - 1e-7]
            total = sum(x * mass[y] for x, y in near)
            shares.append(min(1, len(near) / k) * sum(x * mass[y] for x, y in near if y) / total if total else 0)
        lead = sorted(shares, reverse=True)[:2]
        return sum(lead) / len(lead) if lead else 0.0

    own = {d: share(t, d) for d, t, _ in train}
    return {d: share(t) for d, t in docs}, own, {d: (y, mass[y]) for d, _, y in train}


def test_shares_and_scores_against_brute_force(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + (r.choice(["", " trash", " trash loser", " trash loser filth scum" * 2]) if i % 4 == 0 else " trash" if i % 9 == 0 else "")) for i in range(120)]
    docs[7] = (7, None)
    labels = [(i, int(i % 4 == 0)) for i in range(100)] + [(4, 0), (4, 1)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, share string").repartition(4)
    lab = spark.createDataFrame([(d, 0, y) for d, y in labels], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in score_documents(df, lab).collect()}
    shares, own, train = brute_scores(docs, labels)
    assert {d: pytest.approx(s, abs=2e-4) for d, s in shares.items()} == {d: x.share for d, x in got.items()}
    # the score is the isotonic fit: non-decreasing in the share, and of the right mean
    rows = sorted((x.share, x.score) for x in got.values())
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(rows, rows[1:], strict=False))
    x, y = isotonic(np.array([own[d] for d in train]), np.array([v[0] for v in train.values()]), np.array([v[1] for v in train.values()]))
    for d, v in got.items():  # at the share by plain sums, give or take what single precision loses
        low, high = np.interp([shares[d] - 4e-4, shares[d] + 4e-4], x, y)
        assert low - 1e-3 <= v.score <= high + 1e-3, (d, shares[d], low, v.score, high)
        assert v.predicted == int(v.score >= 0.5)
    assert len({round(v.score, 3) for v in got.values()}) > 3 and {v.predicted for v in got.values()} == {0, 1}
    assert all(v.evidence for d, v in got.items() if shares[d] > 0)


def test_isotonic():
    x, y = isotonic(np.array([0, 1, 2, 3, 3.0]), np.array([0, 1, 0, 1, 0.0]), np.ones(5))
    assert np.interp([0, 1, 2, 3], x, y).tolist() == [0, 0.5, 0.5, 0.5]


def area(pairs):
    """Area under the ROC curve of (score, label)."""
    low, high = ([s for s, y in pairs if y == c] for c in (0, 1))
    return sum((b > a) + (b == a) / 2 for a in low for b in high) / (len(low) * len(high))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op8_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[d].score, y) for d, y in labels.items() if d in rows and rows[d].held_out]
    caught = [s >= 0.5 for s, y in held if y]
    right = [y for s, y in held if s >= 0.5]
    assert sum(caught) >= 0.9 * len(caught) and sum(right) >= 0.9 * len(right)
    assert area(held) > 0.95 and sum((s - y) ** 2 for s, y in held) / len(held) < 0.02
    assert sum(bool(r.evidence) for r in rows.values()) > 0.98 * len(rows)


def test_edges(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 0, 1), (500, 0, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    assert score_documents(docs, labels).count() == docs.count()
    assert score_documents(docs, labels.limit(0)).filter("score <> 0").count() == 0
    assert score_documents(spark.createDataFrame([], SCHEMA), labels).count() == 0
