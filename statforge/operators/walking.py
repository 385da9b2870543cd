"""Trees: fields of nested payloads at any depth, and rejection that climbs from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept


def walked_fields(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """key, path, value, raw_text, confidence (double) and status of every field in a JSON payload. A
    field is an object with the keys status and confidence, at any depth; what lies inside one
    is not searched. Payloads are VARIANTs, opened one level a round for all rows at once, so
    rounds are as many as the deepest payload has levels. Payloads that are no JSON have no fields."""
    spark = payloads.sparkSession
    here = kept(payloads.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(payload)).alias("v")).filter("v IS NOT NULL"), "walk")
    is_field = "try_variant_get(v, '$.status', 'variant') IS NOT NULL AND try_variant_get(v, '$.confidence', 'variant') IS NOT NULL"
    text = lambda name: f"try_variant_get(v, '$.{name}', 'string')"
    found = None
    while True:
        rows = here.filter(is_field).select(F.col("key").alias(key), "path", *[F.expr(text(n)).alias(n) for n in ("value", "raw_text")], F.expr("try_variant_get(v, '$.confidence', 'double')").alias("confidence"), F.coalesce(F.expr(text("status")), F.lit("missing")).alias("status"))
        found = rows if found is None else found.unionByName(rows)
        step = "path || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END"
        deeper = spark.sql(f"SELECT h.key, {step} AS path, e.value AS v FROM {{rows}} h, LATERAL variant_explode(h.v) e WHERE schema_of_variant(e.value) LIKE 'OBJECT%' OR schema_of_variant(e.value) LIKE 'ARRAY%'", rows=here.filter(f"NOT ({is_field})"))
        here = kept(deeper, "walk")
        if here.isEmpty():
            return found


def rejection_climb(nodes: DataFrame) -> DataFrame:
    """id, parent, rejected and round (0: rejected from the start, null: stands) of a forest
    (id, parent, rejected). A node with children falls once none of them stands; whether it
    goes on is asked round by round until nothing more falls."""
    rows = kept(nodes.select("id", "parent", F.coalesce("rejected", F.lit(False)).alias("rejected")).withColumn("round", F.when(F.col("rejected"), 0)), "climb")
    turn = 0
    while True:
        turn += 1
        fallen = rows.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.bool_and("rejected").alias("_all")).filter("_all")
        new = kept(fallen.join(rows.filter(~F.col("rejected")).select("id"), "id").select("id", F.lit(turn).alias("_turn")), "fallen")
        if new.isEmpty():
            return rows
        rows = kept(rows.join(new, "id", "left").select("id", "parent", (F.col("rejected") | F.col("_turn").isNotNull()).alias("rejected"), F.coalesce("round", "_turn").alias("round")), "climb")
