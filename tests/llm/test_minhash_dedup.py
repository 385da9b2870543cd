"""Operator 3 against its SQL and a brute-force search."""

import random
import re

import pyarrow as pa
import pytest

from statforge.llm.common import marked, staged
from statforge.llm.components import components
from statforge.llm.minhash_dedup import OP3_SQL, among, keep_one, least_matches, near_duplicates, op3_minhash_dedup, without_copies
from statforge.llm.shingles import shingle_sets

from .cases import EDGE_TEXTS, SCHEMA, edge_documents
from .oracle import duck, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets, up = {}, {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        up[d] = d
    find = lambda x: x if up[x] == x else find(up[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def near_copies(seed):
    r = random.Random(seed)
    texts = list(EDGE_TEXTS)
    for _ in range(8):
        words = [r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(r.randint(20, 120))]
        for _ in range(12):
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = "x" + str(r.randint(0, 9))
            texts.append("  ".join(w.upper() if r.random() < 0.1 else w for w in words))
    return texts


def test_sql(spark):
    same_rows(op3_minhash_dedup(spark, "/root/testdata/sf0.001").toPandas(), duck("/root/testdata/sf0.001").execute(OP3_SQL).df())


def test_drifting_copies(spark):
    docs = edge_documents(spark, near_copies(5))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs, 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 4, 80)
    kept = {r.doc_id for r in got if r.kept}
    out = keep_one(docs, 4, 80)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = edge_documents(spark, ["a b c d e f", "a b c d e f"]).selectExpr("cast(null as long) doc_id", "text")
    assert [(r.component_id, r.kept) for r in near_duplicates(docs).collect()] == [(None, True)] * 2


def test_doc_ids_with_several_texts(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = c + " end"
    rows = [(3, a), (4, b), (9, a), (9, b), (12, d), (20, c), (25, d), (25, near), (30, a), (31, near), (31, near), (40, ""), (40, b), (50, "q r s t u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, 4, 80).collect())
    parts = {3: 3, 4: 3, 9: 3, 30: 3, 40: 3, 12: 12, 20: 12, 25: 12, 31: 12, 50: 50}
    assert got == sorted((i, parts[i], parts[i] == i) for i, _ in rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 3), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {3: 3, 7: 3}


@pytest.mark.parametrize("k", range(1, 7))
def test_shingles_of_few_words(k):
    for n in range(7):
        (got,) = shingle_sets(pa.array([" ".join("abcdef"[:n])]), k)
        assert len(got) == (n - k + 1 if n >= k else min(n, 1)), n


def test_pruning_bounds():
    bounds = least_matches(80)
    assert list(bounds) == [32, 64, 96, 128, 160] and all(0 < m < 0.8 * n for n, m in bounds.items())


def test_only_rows_that_may_match_move(spark):
    """Wide rows are sifted by a bitmap before they are joined with ids, at any size."""
    rows = spark.range(-20_000, 20_000).selectExpr("id * 7919 AS doc_id", "id AS s1", "-id AS s2", "repeat('x', 50) AS text")
    ids = staged(rows.filter("s1 % 20 = 0").select("doc_id"), "test-ids")
    held = marked(rows, ids, "doc_id")
    assert held.filter("s1 % 20 = 0 AND NOT maybe").count() == 0
    assert 0 < held.filter("s1 % 20 <> 0 AND maybe").count() < 0.1 * rows.count()
    assert among(rows, ids).count() == ids.count() == 2000
    equal = staged(rows.filter("s1 % 20 = 0").selectExpr("doc_id", "s1", "IF(s1 % 40 = 0, s2, s2 + 1) AS s2"), "test-equal")
    got = without_copies(rows, equal)
    assert got.columns == rows.columns and got.count() == 39_000 and got.filter("s1 % 40 = 0").count() == 0
    assert marked(rows, ids.limit(0), "doc_id").filter("maybe").count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, "b")], "doc_id long, text string")
    assert [r.text for r in among(nulls, spark.createDataFrame([(3,)], "doc_id long")).collect()] == ["b"]
