"""Input tables as the analytics see them, plus file readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("title_slug", "gamertag", "game_mode", "position_scope", "role_group", "asset_path")])
RAW = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("payload", T.StringType())])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task takes where it is dealt by ``dealt``.
TASK_ROWS = 300_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by keys into tasks of about ``rows`` rows, so that a task's memory does not grow
    with the table: partitions that are joined up to a size in compressed bytes hold millions of
    narrow rows. Rows of ``df`` are counted, or of ``like``, a table of about as many: a table's
    files know their counts."""
    n = (df if like is None else like).count()
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // (rows or TASK_ROWS))), *keys)


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSS").when(F.col("o_orderstatus") == "P", "OTL").otherwise("DNF")
    return o.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("opponent_id"), F.col("o_orderdate").alias("played_at"), result.alias("result"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("mode"), F.year("o_orderdate").cast("long").alias("title"), F.col("o_totalprice").cast("decimal(18,2)").alias("score"),
    )


def player_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each match and player, dealt by match, so that what follows by match needs no
    other shuffle."""
    rows = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"))
    return rows.agg(
        F.sum("l_quantity").cast("long").alias("goals"), F.count("*").alias("shifts"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("toi"),
        F.bool_or(F.col("l_returnflag") == "R").alias("is_goalie"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).cast("long").alias("saves"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"), "props")


#: The same tables in SQL.
MATCHES = """matches AS (SELECT o_orderkey AS match_id, o_custkey AS opponent_id, o_orderdate AS played_at,
  CASE o_orderstatus WHEN 'F' THEN 'WIN' WHEN 'O' THEN 'LOSS' WHEN 'P' THEN 'OTL' ELSE 'DNF' END AS result,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS mode, CAST(year(o_orderdate) AS BIGINT) AS title, CAST(o_totalprice AS DECIMAL(18,2)) AS score FROM orders)"""
PLAYERS = """pm AS (SELECT l_orderkey AS match_id, l_suppkey AS player_id, CAST(sum(l_quantity) AS BIGINT) AS goals, count(*) AS shifts,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS toi, bool_or(l_returnflag = 'R') AS is_goalie, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS BIGINT) AS saves FROM lineitem GROUP BY 1, 2)"""
EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, props FROM events)"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; values trimmed, missing ones empty."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False)
    return rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in MANIFEST.fieldNames()])


def read_documents(spark: SparkSession, glob: str, schema: T.StructType, version: str | None = None) -> DataFrame:
    """JSON documents, one a file; with ``version`` others than it are left out."""
    rows = spark.read.schema(schema).json(glob, multiLine=True)
    return rows if version is None else rows.filter(F.col("version") == version)


def dated_files(spark: SparkSession, root: str, since: str) -> DataFrame:
    """path, length and day of files whose name holds yyyy-mm-dd on or after ``since``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    day = F.try_to_timestamp(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1)).cast("date")
    return files.withColumn("day", day).filter(F.col("day") >= since)


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Append that ignores duplicates: rows of keys not stored yet, one each."""
    return incoming.dropDuplicates(keys).join(stored, keys, "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest version of each key wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return stored.unionByName(incoming).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merged(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored values win and incoming ones fill their nulls."""
    values = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    return stored.join(new, keys, "full").select(*keys, *[F.coalesce(c, f"_new_{c}").alias(c) for c in values])


def guarded(stored: DataFrame, proposals: DataFrame, key: str, value: str, origin: str) -> DataFrame:
    """Proposals replace values except where the origin is 'manual'."""
    p = proposals.select(key, F.col(value).alias("_new"))
    fixed = F.col(origin).eqNullSafe("manual")
    return stored.join(p, key, "left").withColumn(value, F.when(fixed | F.col("_new").isNull(), F.col(value)).otherwise(F.col("_new"))).drop("_new")


def history(changes: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """Type-2 history: seen_from and seen_until, null for the current row."""
    w = Window.partitionBy(key).orderBy(ts)
    kept = changes.withColumn("_before", F.lag(value).over(w)).filter(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")
    return kept.select(key, value, F.col(ts).alias("seen_from"), F.lead(ts).over(w).alias("seen_until"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)



def filled_keys(tables: dict[str, DataFrame], unit: str, value, key: str, fill) -> dict[str, DataFrame]:
    """Each table with ``key`` set to ``fill`` in the rows of one unit where it is null."""
    here = (F.col(unit) == value) & F.col(key).isNull()
    return {name: t.withColumn(key, F.when(here, F.lit(fill)).otherwise(F.col(key))) for name, t in tables.items()}


def write_sidecars(rows: DataFrame, folder: str, by: list[str]) -> None:
    """JSON lines of evidence beside the tables, a folder for each value of ``by``; only the
    folders that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(folder)


def reported(stored: DataFrame, incoming: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Report rows with the incoming ones added. A key that is stored already fails the
    query unless ``force`` is given; then the incoming row takes its place."""
    known = stored.select(*keys, F.lit(True).alias("_known")).distinct()
    rows = incoming.join(known, keys, "left")
    if force:
        return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(rows.drop("_known"))
    clash = F.raise_error(F.concat(F.lit("a report is stored already for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))).cast("boolean")
    fresh = rows.filter(F.when(F.col("_known"), clash).otherwise(F.lit(True))).drop("_known")
    return stored.unionByName(fresh)


def reviewed_records(spark: SparkSession, path: str, required: list[str], numbers: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) records of reviewed JSON: files that hold an array, or an object
    with an array ``records``. Records are maps of text; those without a required field, or
    with a number that is none, are refused with the reason; numbers are cast."""
    text = spark.read.text(path, wholetext=True)
    kind = "array<map<string,string>>"
    whole = F.coalesce(F.from_json("value", kind), F.from_json("value", f"records {kind}")["records"])
    rows = text.select(F.explode(whole).alias("r"))
    missing = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: F.coalesce(F.trim(F.element_at(F.col("r"), c)), F.lit("")) == "")
    bad = F.array_compact(F.array(*[F.when(F.col("r")[c].isNotNull() & (F.col("r")[c] != "") & F.col("r")[c].try_cast(t).isNull(), F.lit(c)) for c, t in numbers.items()]))
    reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(F.size(bad) > 0, F.concat(F.lit("no number: "), F.array_join(bad, ", ")))
    rows = rows.withColumn("reason", reason)
    plain = [c for c in required if c not in numbers]
    good = rows.filter("reason IS NULL").select(*[F.col("r")[c].alias(c) for c in plain], *[F.col("r")[c].try_cast(t).alias(c) for c, t in numbers.items()])
    return good, rows.filter("reason IS NOT NULL").select("r", "reason")
