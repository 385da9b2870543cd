"""Incremental ingestion: raw rows first, each key once, aggregates of touched groups.

A batch is appended to the raw store only for keys not stored yet, rows that do not parse
go to a quarantine folder with the reason, and the aggregate is recomputed for the groups
the batch touched and written over their partitions. A repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import new_rows, replace_partitions

PAYLOAD = T.StructType([T.StructField("result", T.StringType()), T.StructField("score", T.StringType())])
RAW = T.StructType([T.StructField("title", T.LongType()), T.StructField("match_id", T.LongType()), T.StructField("payload", T.StringType())])


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows at ``path``, none if nothing is there yet; any other fault is raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def parsed(raw: DataFrame) -> DataFrame:
    """Payload fields; a missing or empty score is 0, anything else that is no number an error."""
    rows = raw.withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("text", F.coalesce(F.nullif(F.trim("p.score"), F.lit("")), F.lit("0")))
    score = F.col("text").try_cast("long")
    problem = F.when(F.col("p").isNull() | F.col("p.result").isNull(), "no payload").when(score.isNull(), "score is no number")
    return rows.select("title", "match_id", F.sha2("payload", 256).alias("digest"), F.col("p.result").alias("result"), score.alias("score"), problem.alias("problem"))


def ingest_batch(batch: DataFrame, root: str) -> None:
    spark = batch.sparkSession
    keys = ["title", "match_id"]
    fresh = new_rows(batch.select(RAW.fieldNames()), stored(spark, f"{root}/raw", RAW), keys)
    fresh.write.mode("append").partitionBy("title").parquet(f"{root}/raw")
    touched = batch.select("title").distinct()
    rows = parsed(stored(spark, f"{root}/raw", RAW).join(touched, "title", "left_semi"))
    replace_partitions(rows.filter("problem IS NOT NULL"), f"{root}/quarantine", ["title"])
    good = rows.filter("problem IS NULL")
    totals = good.groupBy("title").agg(F.count("*").alias("gp"), F.sum("score").alias("score"), F.count_if(F.col("result") == "WIN").alias("wins"))
    replace_partitions(totals, f"{root}/totals", ["title"])


def start(spark: SparkSession, source: str, root: str, trigger: dict | None = None, batch: Callable = ingest_batch) -> StreamingQuery:
    """Follow a folder of JSON lines. The default trigger takes what is there and ends;
    ``{"processingTime": "5 minutes"}`` polls without overlapping runs."""
    lines = spark.readStream.schema(RAW).json(source)
    writer = lines.writeStream.foreachBatch(lambda df, _: batch(df, root)).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(spark: SparkSession, folder: str, schema: T.StructType, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Not part of the original feature set: event counts by time window under a watermark."""
    e = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def health(log: DataFrame, stale: int = 1800) -> DataFrame:
    """One row: status, last_success, seconds since it. ``log`` holds status and finished_at
    of ingestion runs; without a success the status is degraded, after ``stale`` seconds it
    is stale, else ok."""
    done = log.filter("status = 'success' AND finished_at IS NOT NULL").agg(F.max("finished_at").alias("last_success"))
    age = F.floor(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("last_success"))
    status = F.when(F.col("last_success").isNull(), "degraded").when(age > stale, "stale").otherwise("ok")
    return done.select(status.alias("status"), "last_success", age.alias("seconds"))
