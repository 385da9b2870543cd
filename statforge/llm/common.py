"""Shared helpers: table readers, the shared scratch folder, and Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; only Spark touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    A cluster names it in ``spark.checkpoint.dir`` and must: a folder of one machine is no
    use to others. Where that is unset and all runs on this machine (tests) a temporary
    folder is made once and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="statforge-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files
    that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(columns: list[str], *more: Column) -> Column:
    """Columns as one struct, so that names of working columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in columns], *more)


def unpacked(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` put into the struct ``name``."""
    return rows.select(*[F.col(name).getField(c).alias(c) for c in columns])


#: Bits of a bitmap of ``marked`` for each id, and most bits of one (32 MB).
MARK_BITS, MOST_BITS = 16, 1 << 28


def marked(rows: DataFrame, ids: DataFrame, key: str, name: str = "maybe") -> DataFrame:
    """``rows`` with a boolean column ``name``: true wherever ``key`` is in the column ``key`` of
    ``ids``, and by chance for about one in 16 of the others (more beyond 16 million ids). Every
    task gets a bitmap of the ids' hashes, two bytes an id, so that a join with ``ids`` has to
    move only the rows that it lets pass. ``ids`` should be staged, as they are counted."""
    bits = min(MOST_BITS, 32768 * -(-MARK_BITS * max(1, ids.count()) // 32768))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    bucket, position = F.bitmap_bucket_number(at), F.bitmap_bit_position(at).cast("int")
    maps = ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    hit = F.getbit(byte, position % 8) == 1
    met = rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket", "left")
    return met.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype="<i8", count=n + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes (a longer text is a slice
    of its own), which bounds what a task holds at a time. Needs a ``text`` column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index("text"))
        lengths = np.array(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
        cut = np.cumsum(lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
