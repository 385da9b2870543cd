"""Operators 2, 7 and 9 against the tokenizers library over whole texts."""

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from statforge.llm.packing import assign, pack_documents
from statforge.llm.token_counts import PieceCounter, count_tokens, merged_count
from statforge.llm.token_ids import PieceEncoder, tokenizer_path
from statforge.llm.token_output import ids_crc32, read_token_files, with_starts, write_token_files

from .cases import EDGE_TEXTS, SCHEMA, edge_documents

SF = "/root/testdata/sf0.001"


def brute(name, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("from_files", [False, True])
def test_token_files(spark, tmp_path, from_files):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if from_files else edge_documents(spark)
    path = str(tmp_path / "ids")
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    got = {r.doc_id: (r.start, r.n, r.c) for r in with_starts(read_token_files(spark, path).selectExpr("*", "size(tokens) n").withColumn("c", ids_crc32()).drop("tokens"), read_token_files(spark, path)).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    start = 0
    for r, ids in zip(rows, brute("word_bpe_49k.json", [r.text for r in rows]), strict=True):
        ids = [*ids, 2]
        assert got[r.doc_id] == (start, len(ids), crc(ids)), r.doc_id
        start += len(ids)
    assert len(got) == len(rows)


def test_metadata_reads_leave_ids_alone(spark, tmp_path):
    path = str(tmp_path / "ids")
    write_token_files(edge_documents(spark), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    plan = with_starts(read_token_files(spark, path).drop("tokens"), read_token_files(spark, path)).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert " tokens#" not in plan and ",tokens#" not in plan and "[tokens#" not in plan


@pytest.mark.parametrize("from_files", [False, True])
def test_counts(spark, from_files):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if from_files else edge_documents(spark)
    got = {r.doc_id: r for r in count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 1024).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, ids in zip(rows, brute("byte_bpe_50k.json", [r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_bytes, g.over_limit) == (len(ids), len((r.text or "").encode()), len(ids) > 1024)


#: Every string of up to 4 of these signs; among them lines that hold U+00A0 only.
SIGNS = ["a", ".", "\n", " ", "\u00a0", "\u3000", "\t", "\r"]
FEED_TEXTS = ["Hello\n\u00a0\nworld", "Hello\n\u00a0", *("".join(t) for n in range(1, 5) for t in product(SIGNS, repeat=n))]


def test_counts_around_line_feeds():
    counter = PieceCounter(tokenizer_path("byte_bpe_50k.json"))
    got = [counter.count(t) for t in FEED_TEXTS]
    assert got[:2] == [4, 2]
    assert got == [len(ids) for ids in brute("byte_bpe_50k.json", FEED_TEXTS)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_around_line_feeds(name):
    got = PieceEncoder(tokenizer_path(name)).encode(FEED_TEXTS)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == brute(name, FEED_TEXTS)


def test_merged_count():
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("a", "a"): 3}
    assert merged_count(list("abc"), ranks) == 1
    assert merged_count(list("aaa"), ranks) == 2
    assert merged_count([], ranks) == 0
    assert merged_count(list("xbc"), ranks) == 2


@pytest.mark.parametrize("from_files", [False, True])
def test_packing(spark, from_files):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if from_files else edge_documents(spark)
    pieces = pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, pack_tokens=40_000, with_ids=True).collect()
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: [*ids, 1] for r, ids in zip(rows, brute("byte_bpe_50k.json", [r.text for r in rows]), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == crc(want[p.doc_id][p.start : p.start + p.length]) and list(p.ids) == want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and p.length > 0
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans, total in [(by_doc[k], len(v)) for k, v in want.items()] + [(v, None) for v in by_sequence.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total is not None else at <= 2048


def test_assign_fills_sequences():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 5000, 400)
    rows, n = assign(lengths, 2048)
    assert n <= -(-int(lengths.sum()) // 2048) + 1
    assert sum(r[2] for r in rows) == lengths.sum()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1).count() == 0
    assert count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 5).count() == 0
    write_token_files(docs, str(tmp_path / "ids"), tokenizer_path("word_bpe_49k.json"), 2)
    assert read_token_files(spark, str(tmp_path / "ids")).count() == 0


def test_repeated_rows(spark):
    docs = edge_documents(spark, EDGE_TEXTS[18:20]).unionByName(edge_documents(spark, EDGE_TEXTS[18:20]))
    assert count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 5).count() == 4


def test_column_of_words_against_library():
    """Random strings over signs that split words in odd ways."""
    rng = np.random.default_rng(5)
    signs = np.array(["a", "B", "é", "ß", "Σ", "'s", ".", ",", "1", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　", "́", "<|endoftext|>", "the", "中"])
    texts = [None, *("".join(rng.choice(signs, rng.integers(0, 9))) for _ in range(20_000))]
    ids, edges = PieceEncoder(tokenizer_path("word_bpe_49k.json")).encode_column(pa.array(texts), 2)
    want = brute("word_bpe_49k.json", texts)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [[*x, 2] for x in want]
    assert PieceEncoder(tokenizer_path("word_bpe_49k.json")).encode_column(pa.array([], pa.string()), 2)[1].tolist() == [0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_random_strings_against_library(name):
    rng = np.random.default_rng(6)
    signs = np.array(["a", "B", "é", "'s", ".", "1", " ", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", "　", "́", "<|endoftext|>", "the", "中"])
    texts = ["".join(rng.choice(signs, rng.integers(0, 9))) for _ in range(100_000)]
    want = brute(name, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(tokenizer_path(name)).encode(texts)] == want
    counter = PieceCounter(tokenizer_path(name))
    assert [counter.count(t) for t in texts] == list(map(len, want))


def test_long_text_null_and_repeated_ids(spark, tmp_path):
    """A text above a batch slice; a null doc_id; a doc_id with two texts."""
    long = "some words and more, " * 900_000
    docs = spark.createDataFrame([(1, long), (None, "x y"), (2, "b a"), (2, "a b"), (2, "a b")], "doc_id long, text string")
    path = str(tmp_path / "ids")
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    rows = with_starts(read_token_files(spark, path).withColumn("c", ids_crc32()).drop("tokens"), read_token_files(spark, path)).orderBy("start").collect()
    texts = ["x y", long, "a b", "a b", "b a"]
    want = [[*x, 2] for x in brute("word_bpe_49k.json", texts)]
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2]
    assert [(r.n_tokens, r.c) for r in rows] == [(len(x), crc(x)) for x in want]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()
    counts = {(r.doc_id, r.n_tokens) for r in count_tokens(docs, tokenizer_path("byte_bpe_50k.json"), 5).collect()}
    byte = brute("byte_bpe_50k.json", [long, "x y"])
    assert {(1, len(byte[0])), (None, len(byte[1]))} <= counts
    pieces = pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == len(byte[0]) + 1
