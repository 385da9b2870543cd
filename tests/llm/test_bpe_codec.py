"""Operator 12 against the tokenizers library: encoding, decoding, cuts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from statforge.llm.bpe_codec import Decoder, ForcedBoundaryEncoder, decode_documents, encode_documents, op12_bpe_codec, pairs_in, vocabulary
from statforge.llm.token_ids import tokenizer_path

from .cases import EDGE_TEXTS, SCHEMA, edge_documents

PATH = tokenizer_path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SIGNS = ["a", "B", "é", "'s", "'", ".", "!", "1", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", "　", "́", "<|endoftext|>", "<|", "|>", "the", "中", "\U0001f600", "'re", "'l", "l", "q", "z", "#"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_random_strings_against_library():
    rng = np.random.default_rng(6)
    texts = [None, *("".join(rng.choice(SIGNS, rng.integers(0, 10))) for _ in range(100_000))]
    tokenizer = library()
    want = [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = ForcedBoundaryEncoder(PATH).encode(pa.array(texts, pa.string()))
    assert got.to_pylist() == want
    assert Decoder(PATH).decode(got) == [tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_ids_of_any_order_decode_as_the_library():
    """Ids that no text has, whose bytes are no UTF-8, come back as replacement signs."""
    rng = np.random.default_rng(7)
    ids = [rng.integers(0, 50257, rng.integers(0, 6)).tolist() for _ in range(5000)]
    tokenizer = library()
    assert Decoder(PATH).decode(pa.array(ids, pa.list_(pa.int32()))) == [tokenizer.decode(x, skip_special_tokens=False) for x in ids]
    assert Decoder(PATH).decode(pa.array([[-5, 10**6]], pa.list_(pa.int32()))) == [""]


def test_cuts_fall_between_pairs_of_no_token():
    tokens, special = vocabulary(PATH)
    assert special == ["<|endoftext|>"] and len(tokens) == 50257
    pairs = pairs_in(tokens)
    encoder = ForcedBoundaryEncoder(PATH)
    text = "Hello world, it's <|endoftext|> naïve Straße  and　more"
    pieces, first = encoder.fragments(pa.array([text, "", "x"]))
    found = pieces.to_pylist()
    assert b"".join(found) == (text + "x").encode() and first.tolist() == [0, len(found) - 1, len(found) - 1, len(found)]
    assert all(not pairs[a[-1], b[0]] for a, b in zip(found[:-2], found[1:-1], strict=True))
    assert len(found) > 6 and b" world" in found


@pytest.mark.parametrize("from_files", [False, True])
def test_documents(spark, from_files):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if from_files else edge_documents(spark).unionByName(edge_documents(spark, EDGE_TEXTS[18:20]))
    tokenizer = library()
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.text, list(r.ids)) for r in decode_documents(encode_documents(docs, PATH), PATH).collect())
    assert got == [(i, t, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows]


def test_query(spark):
    tokenizer = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_bpe_codec(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    long = "some words, and more; " * 300_000
    docs = spark.createDataFrame([(1, long, [1], "x"), (None, "a", [2], "y")], "doc_id long, text string, ids array<int>, value string")
    rows = {r.doc_id: r for r in decode_documents(encode_documents(docs, PATH), PATH).collect()}
    assert rows[1].text == long and rows[None].text == "a" and len(rows[1].ids) == 1_800_001
    assert encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [64]), (3, None)], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in decode_documents(nulls, PATH).collect()) == [(1, ""), (2, "a"), (3, "")]


def test_small_memory_of_fragments():
    encoder = ForcedBoundaryEncoder(PATH, limit=3)
    for text in ("some words here", "other words there", "some words here"):
        assert encoder.encode(pa.array([text])).to_pylist() == [library().encode(text, add_special_tokens=False).ids]
