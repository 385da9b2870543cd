"""Operator 2: token ids in a binary file format.

The format is Parquet: one row per document with its id, shard, place in the shard,
length, and the ids as a list column. Ids are dictionary-encoded (a vocabulary fits one
dictionary page), the sorted numeric columns are delta-encoded (writer version 2), row
groups are small and pages hold a bounded number of rows with their column indexes, so a
reader fetches lengths without ids, or the ids of a few documents, by skipping pages.

Documents are range-partitioned and sorted by id before encoding, so files in name order
hold ids in document order. Places across shards come from a prefix sum over one row per
shard, read from the metadata columns alone.

Nulls: a null text is empty; a null doc_id sorts first and is kept. Repeated doc_ids are
kept, in text order. A very long text is encoded whole, on its own; its task holds the text
and its ids. An empty table gives an empty file set. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table, text_batches
from .token_ids import tokenizer_path, worker_encoder

FILE_SCHEMA = "doc_id long, shard long, local_start long, n_tokens long, tokens array<int>"
#: Text bytes encoded at a time; a longer text is encoded on its own.
SLICE = 16 << 20
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of the file format for ``docs`` (doc_id, text), in ascending doc_id order."""

    def run(batches):
        encoder = worker_encoder(tokenizer)
        shard, place = TaskContext.get().partitionId(), 0
        for batch in text_batches(batches, SLICE):
            ids, offsets = encoder.encode_column(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, shard, dtype=np.int64)),
                    pa.array(place + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                ["doc_id", "shard", "local_start", "n_tokens", "tokens"],
            )
            place += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILE_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    encode_documents(docs, tokenizer, end_id).write.options(**WRITER).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Ids are read only if ``tokens`` is selected."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before the document, to rows with ``shard`` and
    ``local_start``. Drop ids from ``rows`` first, as rows are joined with shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def ids_crc32(column: str = "tokens"):
    """Unsigned CRC-32 of a list of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(lists: pa.Array) -> pa.Array:
        ids = memoryview(np.ascontiguousarray(lists.flatten().to_numpy().astype("<i4", copy=False))).cast("B")
        ends = (4 * np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
        return pa.array([zlib.crc32(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.int64())

    return crc(F.col(column))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    files = read_token_files(spark, path)
    rows = files.select("doc_id", "shard", "local_start", F.size("tokens").cast("long").alias("n_tokens"), ids_crc32().alias("ids_crc32"))
    return with_starts(rows, files).select("doc_id", "start", "n_tokens", "ids_crc32")
