"""Operators 5 and 10."""

import hashlib
import io

import numpy as np
import pytest

from statforge.llm.topk_search import NONE, OP10_SQL, Search, op10_topk_search, top_k
from statforge.llm.warc import OP5_SQL, BadArchive, op5_warc, read_archives, read_records, record_bytes, write_archives

from .oracle import duck, same_rows

SF = "/root/testdata/sf0.001"


def test_warc_sql(spark):
    same_rows(op5_warc(spark, SF).toPandas(), duck(SF).execute(OP5_SQL).df())


def test_warc_edges(spark, tmp_path):
    same, small = "é" * 60, "tiny"
    rows = [(1, "http://a\r\nb", None), (5, None, same), (2, "u", same), (9, "u", same), (3, "u", small), (4, "u", small), (6, "u", ""), (None, "u", same), (7, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in read_archives(write_archives(pages, f"file:{tmp_path}/w"), f"file:{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    assert {k: v.refers_to for k, v in got.items() if v.record_type == "revisit"} == {5: 2, 9: 2}
    assert got[5].payload_bytes == 120 and got[5].payload_digest == got[2].payload_digest and got[7].payload_bytes == 300_000
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(empty, f"file:{tmp_path}/e"), f"file:{tmp_path}/e").count() == 0


def test_warc_repeated_ids(spark, tmp_path):
    """A page_id with several payloads loses none of them."""
    a, b = "a" * 120, "b" * 120
    pages = spark.createDataFrame([(1, "u", a), (2, "u", a), (2, "u", b), (3, "u", b), (3, "u", a), (3, "u", a)], "page_id long, url string, html string")
    got = read_archives(write_archives(pages, f"file:{tmp_path}/w"), f"file:{tmp_path}/w").collect()
    digest = {x: hashlib.sha256(x.encode()).hexdigest() for x in (a, b)}
    want = [(1, digest[a], None), (2, digest[a], 1), (2, digest[b], None), (3, digest[b], 2), (3, digest[a], 1), (3, digest[a], 1)]
    assert sorted(((r.page_id, r.payload_digest, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_reader_round_trip_and_damage():
    payloads = [b"", b"a", bytes(range(256)) * 2000]
    data = b"".join(record_bytes(i, "u", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads))
    for step in (1, 7, 1 << 16):
        stream = io.BytesIO(data)
        assert [r["payload"] for r in read_records(lambda n, s=stream, k=step: s.read(min(n, k)), with_payload=True)] == payloads
    with pytest.raises(BadArchive):
        list(read_records(io.BytesIO(data[:-20]).read))
    with pytest.raises(BadArchive):
        list(read_records(io.BytesIO(record_bytes(1, "u", b"abc", "0" * 64, None)).read))


def test_topk_sql(spark):
    same_rows(op10_topk_search(spark, SF).toPandas(), duck(SF).execute(OP10_SQL).df())


def test_topk_edges(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 8))
    rows = [(i, (near[i % 6] * 5 + rng.normal(size=8) * 0.01).tolist()) for i in range(600)]
    rows += [(600 + i, [1.0] * 8) for i in range(200)] + [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [2.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    fine = {i: np.pad(np.floor(1024 * np.array(v, float)), (0, 8 - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, least_blocks=3).collect())
    want = []
    for q in fine:
        if q % 100 == 0:
            best = sorted(((-int(fine[q] @ x), i) for i, x in fine.items() if i != q))[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def brute_top(fine, k=10):
    want = []
    for q in fine:
        if q % 100 == 0:
            best = sorted(((-int(sum(int(a) * int(b) for a, b in zip(fine[q], x, strict=True))), i) for i, x in fine.items() if i != q))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(want)


def test_topk_scores_above_2_53(spark):
    """Integer scores far beyond what floating point holds exactly."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(1 << 29, 1 << 30, 4) / 1024.0).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, least_blocks=2).collect())
    assert got == brute_top({i: [int(np.floor(1024 * x)) for x in v] for i, v in rows})
    assert min(s for *_, s in got) > 1 << 59


def test_topk_few_rows_and_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (100, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in top_k(df).collect())
    # query 0 stands for two equal rows, each with three candidates
    assert [g for g in got if g[0] == 100] == [(100, 1, 7), (100, 2, 7), (100, 3, 0), (100, 4, 0)]
    assert [g[2] for g in got if g[0] == 0] == [7, 7, 7, 7, 100, 100]


def test_dual_tree_prunes_clusters():
    """On clustered vectors most pairs are dropped by bounds; the result stays exact."""
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(30, 16)) * 3000
    x = np.floor(centers[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 20)
    ids = np.arange(6000)
    q = x[:200]
    search = Search(q, ids[:200], np.full(200, NONE), x, ids, 10)
    q_ids, found, score = search.run()
    s = (q @ x.T).astype(np.int64)
    s[np.arange(200), np.arange(200)] = NONE
    want = np.lexsort((np.broadcast_to(ids, s.shape), ~s), axis=1)[:, :10]
    assert found.reshape(200, 10).tolist() == want.tolist()
    assert search.scored < 0.35 * 200 * 6000
