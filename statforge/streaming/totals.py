"""Totals that streams keep in state: each row is read once, however long the history.

Queries stand in a row, each with its own checkpoint. ``raw`` takes lines as they are,
drops keys seen before and commits files exactly once. ``quarantine`` and ``totals`` follow
those files: rows that do not parse, and counts a title that live in the state store and are
written over the title's folder whenever they change. A batch costs what it holds itself.

A key is remembered for ``late`` after its event time and rows older than the watermark are
left out, so lines sent again with their own time change nothing, early or late. A key with
a new time more than ``late`` after its first is a new row. Rows without a time cannot be held
against the watermark and are set aside in ``untimed``. Rows with a null title form one title. For states beyond a task's memory set the session's state store to RocksDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import replace_partitions
from .ingest import RAW, parsed

TIMED = T.StructType([*RAW.fields, T.StructField("seen_at", T.TimestampType())])
KEYS = ["title", "match_id"]


def first_seen(lines: DataFrame, late: str) -> DataFrame:
    """Rows with a time whose key was not seen within ``late``."""
    return lines.filter("seen_at IS NOT NULL").withWatermark("seen_at", late).dropDuplicatesWithinWatermark(KEYS)


def title_totals(raw: DataFrame) -> DataFrame:
    good = parsed(raw).filter("problem IS NULL")
    return good.groupBy("title").agg(F.count("*").alias("gp"), F.sum("score").alias("score"), F.count_if(F.col("result") == "WIN").alias("wins"))


def appended(rows: DataFrame, root: str, name: str, trigger: dict) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/checkpoints/{name}")
    return writer.trigger(**trigger).start()


def follow_raw(spark: SparkSession, source: str, root: str, late: str, trigger: dict) -> StreamingQuery:
    return appended(first_seen(spark.readStream.schema(TIMED).json(source), late), root, "raw", trigger)


def follow_untimed(spark: SparkSession, source: str, root: str, trigger: dict) -> StreamingQuery:
    return appended(spark.readStream.schema(TIMED).json(source).filter("seen_at IS NULL"), root, "untimed", trigger)


def follow_quarantine(spark: SparkSession, root: str, trigger: dict) -> StreamingQuery:
    return appended(parsed(spark.readStream.schema(TIMED).parquet(f"{root}/raw")).filter("problem IS NOT NULL"), root, "quarantine", trigger)


def follow_totals(spark: SparkSession, root: str, trigger: dict) -> StreamingQuery:
    """Changed titles of each batch, whole, so that a batch run again writes the same rows."""
    totals = title_totals(spark.readStream.schema(TIMED).parquet(f"{root}/raw"))
    write = lambda changed, _: replace_partitions(changed, f"{root}/totals", ["title"])
    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoints/totals").trigger(**trigger).start()


def follow(spark: SparkSession, source: str, root: str, late: str = "7 days") -> dict[str, StreamingQuery]:
    """Take what is in ``source`` through raw rows to quarantine and totals, then end. To
    keep polling, start the four queries apart with ``{"processingTime": ...}``."""
    now = {"availableNow": True}
    first = {"raw": follow_raw(spark, source, root, late, now), "untimed": follow_untimed(spark, source, root, now)}
    for query in first.values():
        query.awaitTermination()
    rest = {"quarantine": follow_quarantine(spark, root, now), "totals": follow_totals(spark, root, now)}
    for query in rest.values():
        query.awaitTermination()
    return first | rest
