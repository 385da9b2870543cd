"""Operator 9: cost-balanced packing of documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, an estimate of attention
work. Whole windows of a long document become sequences of their own; what is left of
each document is sorted by descending cost and goes to the cheapest open sequence with
room for it. Where none has room, the piece is cut to fill the roomiest ones. The number
of open sequences is the least that holds the tokens, so padding stays below one sequence
for each pack of ``pack_tokens`` tokens.

Packs are formed within a task as rows stream by, so nothing is shuffled and a task holds
one pack at a time. A sequence's id has the task's partition in its upper bits.

Nulls: a null text is empty and has its end id alone. Repeated rows are packed each on
its own; of pieces of equal cost the one met first goes first, to the first of equally cheap
sequences; a very long text is encoded whole, in memory of its own size, and cut into as
many sequences as it needs; an empty table gives no pieces; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches
from .token_ids import tokenizer_path, worker_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def assign(lengths: np.ndarray, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places documents of ``lengths`` tokens. Returns (document, start, length,
    sequence, offset) rows and the number of sequences."""
    out, n = [], 0
    rest = []
    for d, length in enumerate(lengths.tolist()):
        whole = length // size
        for k in range(whole):
            out.append((d, k * size, size, n, 0))
            n += 1
        if length % size:
            rest.append((length % size, d, whole * size))
    if not rest:
        return out, n
    rest.sort(key=lambda x: (-x[0], x[1]))
    most = -(-sum(x[0] for x in rest) // size)
    cost, room = np.zeros(most), np.full(most, size, dtype=np.int64)
    for length, d, start in rest:
        while length:
            fits = np.flatnonzero(room >= length)
            k = int(fits[np.argmin(cost[fits])]) if len(fits) else int(np.argmax(room))
            part = min(length, int(room[k]))
            out.append((d, start, part, n + k, size - int(room[k])))
            room[k] -= part
            cost[k] += linear * part + quadratic * part * part
            start, length = start + part, length - part
    return out, n + most


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, pack_tokens: int = 2 << 20, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the piece's ids."""

    def flush(packed, encoded, next_id):
        ids = [b for _, b in packed]
        rows, used = assign(np.array([len(b) // 4 for b in ids], dtype=np.int64), size)
        parts = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows]
        columns = [
            pa.array([packed[r[0]][0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            pa.array([len(ids[r[0]]) // 4 for r in rows], pa.int64()),
            pa.array([next_id + r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if encoded:
            offsets = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), used

    def run(batches):
        encoder = worker_encoder(tokenizer)
        end, next_id = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 32
        packed, held = [], 0
        for batch in text_batches(batches):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                packed.append((doc_id, x + end))
                held += len(x) // 4 + 1
                if held >= pack_tokens:
                    rows, used = flush(packed, with_ids, next_id)
                    yield rows
                    packed, held, next_id = [], 0, next_id + used
        if packed:
            yield flush(packed, with_ids, next_id)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1)
