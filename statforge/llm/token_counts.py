"""Operator 7: token counts without token ids.

A pre-token's count is its number of bytes less the merges that byte-pair encoding makes
in it. Symbols form a linked list; a heap holds adjacent pairs by merge rank, the lowest
is popped, and a popped pair counts if both its symbols still stand. Pieces between
single spaces are counted apart and a bounded cache keeps their counts.

Nulls: a null text is empty and has no tokens. Repeated rows and doc_ids are each
counted; a very long text is counted whole, on its own, in memory of its own size; equal
ranks (there are none in a vocabulary) fall to the leftmost pair; an empty table gives no
rows; other columns are ignored, whatever their names. Special strings are one token each, as the library's
default has it, and split the text around them.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches
from .token_ids import BYTE_SIGNS, LONE_FEED, LONG, STOPS, Pieces, pieces_of, tokenizer_path

#: Fixed value: how the byte-level vocabulary splits text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left after all merges, lowest rank first, leftmost on ties."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], a + b))
    return left


@functools.lru_cache(maxsize=2)
def worker_counter(path: str) -> PieceCounter:
    """The counter of a Python worker, which keeps the pieces it knows from task to task."""
    return PieceCounter(path)


class PieceCounter:
    """``count(text)``: tokens of a text; about ``limit`` pieces are remembered."""

    def __init__(self, path: str, limit: int = 600_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = special
        self.split_special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.limit = limit
        self.head = Pieces(lambda piece: self._learn(piece, self.head, ""))
        self.rest = Pieces(lambda piece: self._learn(piece, self.rest, " "))

    def _merge(self, word: str) -> int:
        return merged_count(word.encode().decode("latin-1").translate(BYTE_SIGNS), self.ranks)

    def _learn(self, piece: str, known: Pieces, lead: str) -> int:
        if "\n" in piece:
            lines = LONE_FEED.split(piece)
            if len(lines) > 1:  # a line feed between characters other than white space is a token of its own
                return known[lines[0]] + sum(1 + self.head[x] for x in lines[1:])
        word = piece.rstrip(STOPS)
        if not word.isalpha() or max(word) > "\xff":
            value = sum(map(self._merge, self.pre_tokens.findall(lead + piece)))
        elif len(word) < len(piece):
            value = known[word] + self.head[piece[len(word) :]]
        else:
            value = self._merge(lead + word)
        if len(piece) <= LONG:
            known[piece] = value
        return value

    def _plain(self, text: str) -> int:
        first, *others = pieces_of(text)
        return (self.head[first] if first else 0) + sum(map(self.rest.__getitem__, others))

    def count(self, text: str) -> int:
        if len(self.head) + len(self.rest) > self.limit:
            self.head.clear()
            self.rest.clear()
        if any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) per row."""

    def run(batches):
        counter = worker_counter(tokenizer)
        for batch in text_batches(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)
