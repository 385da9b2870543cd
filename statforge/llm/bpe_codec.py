"""Operator 12: BPE encoding by forced boundaries, and decoding.

A merge makes a vocabulary token, so two neighbouring bytes that stand side by side in no
token can never be merged over: between them there is a certain cut. A 256 x 256 table of the
byte pairs that some token holds is read off the vocabulary, the bytes of a batch of texts are
cut with it at once, each distinct fragment is encoded alone, and the ids of fragments
are joined. Splitting into words before merging must see the same context on both sides, so a
cut is made only after a character that is no white space (behind one the length of a run of
white space could change), not before an apostrophe (which could become a contraction), and not
inside a character. Special tokens are tokens too: their inner pairs are never cut, and fragments
that may hold one are encoded whole by the library. Decoding joins the bytes of the tokens,
``decode`` of a text being the join of those of its fragments.

Nulls: a null text is empty and has no tokens; null ids decode to empty text. Repeated rows
are each encoded, a very long text is a slice of its own in its task, there are no ties, and an
empty table gives no rows. Other columns are ignored, whatever their names. Bytes that are not
UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, utf8_column
from .token_ids import BYTE_SIGNS, tokenizer_path

#: White space of one byte, as the splitting of words has it (\x1c-\x1f count to be safe).
SPACES = [*range(9, 14), *range(28, 33)]
#: First bytes of characters that may be white space: C2 (U+0085, U+00A0), E1, E2, E3.
SPACE_LEADS = [0xC2, 0xE1, 0xE2, 0xE3]
#: Fragments that one worker remembers, and the longest of them in bytes.
REMEMBERED, LONG = 200_000, 100


def vocabulary(path: str) -> tuple[list[bytes], list[str]]:
    """Bytes of each token by id, and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {chr(sign): b for b, sign in BYTE_SIGNS.items()}
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    plain = {i: bytes(map(byte_of.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in special}
    known = plain | {i: s.encode() for i, s in special.items()}
    return [known.get(i, b"") for i in range(max(known) + 1)], [*special.values()]


def pairs_in(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether some token holds this byte right before that one."""
    found = np.zeros((256, 256), bool)
    for t in tokens:
        b = np.frombuffer(t, np.uint8)
        found[b[:-1], b[1:]] = True
    return found


class ForcedBoundaryEncoder:
    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        tokens, self.special = vocabulary(path)
        cut = ~pairs_in(tokens)
        cut[SPACES] = False
        cut[:, ord("'")] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        self.cut = cut
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def fragments(self, column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The fragments of all texts one after another, and where each text's begin."""
        flat, offsets = utf8_column(column)
        n = len(flat)
        if not n:
            return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
        here = np.zeros(n + 1, bool)
        here[1:n] = self.cut[flat[:-1], flat[1:]]
        high = np.flatnonzero(here[1:n] & (flat[:-1] >= 0x80)) + 1  # cuts behind longer characters
        if len(high):
            lead = high - 1
            for _ in range(3):
                lead = np.where(flat[lead] < 0xC0, np.maximum(lead - 1, 0), lead)
            here[high[np.isin(flat[lead], SPACE_LEADS)]] = False
        here[offsets] = True
        starts = np.flatnonzero(here)
        count = np.searchsorted(starts, offsets)
        buffers = [None, pa.py_buffer(starts.astype("<i8")), pa.py_buffer(np.ascontiguousarray(flat))]
        return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, buffers), count

    def learn(self, new: list[bytes]) -> None:
        texts = [b.decode("utf-8", "replace") for b in new]
        for fragment, found in zip(new, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            self.known[fragment] = np.array(found.ids, "<i4").tobytes()

    def encode(self, column: pa.Array) -> pa.ListArray:
        """Token ids of each text."""
        pieces, first = self.fragments(column)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self.known.clear()
        self.learn([p for p in distinct if p not in self.known])
        ids = [self.known[p] for p in distinct]
        for p in distinct:
            if len(p) > LONG:
                del self.known[p]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, starts = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        size = lengths[codes]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        flat = values[np.repeat(starts[codes] - upto + size, size) + np.arange(total)]
        edges = np.concatenate([[0], upto])[first]
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))


class Decoder:
    def __init__(self, path: str):
        tokens, _ = vocabulary(path)
        self.size = np.array([*map(len, tokens), 0], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, column: pa.Array) -> list[str]:
        """The text of each list of ids; unknown ids have no bytes."""
        edges, ids = column.offsets.to_numpy(), column.flatten().fill_null(-1).to_numpy()
        ids = np.where((ids < 0) | (ids >= len(self.size) - 1), len(self.size) - 1, ids)
        size = self.size[ids]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        data = self.flat[np.repeat(self.start[ids] - upto + size, size) + np.arange(total)].tobytes()
        ends = np.concatenate([[0], upto])[edges - edges[0]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def id_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows (key, ids) in slices of about ``most`` ids; null ids are an empty list."""
    for batch in batches:
        ids = batch.column(1)
        if ids.null_count:
            ids = pa.array([x or [] for x in ids.to_pylist()], pa.list_(pa.int32()))
        cut = (ids.offsets.to_numpy()[1:].astype(np.int64) - ids.offsets[0].as_py()) // most
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], ids[a:b]], ["doc_id", "ids"])


@functools.lru_cache(maxsize=2)
def worker_encoder(path: str) -> ForcedBoundaryEncoder:
    """The encoder of a Python worker, which keeps the fragments it knows from task to task."""
    return ForcedBoundaryEncoder(path)


@functools.lru_cache(maxsize=2)
def worker_decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text."""

    def run(batches):
        encoder = worker_encoder(tokenizer)
        for batch in text_batches(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.encode(batch.column(1))], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""

    def run(batches):
        decoder = worker_decoder(tokenizer)
        for batch in id_batches(batches):
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoder.decode(ids), pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    rows = decode_documents(encode_documents(table(spark, sf_dir, "documents"), path), path)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
