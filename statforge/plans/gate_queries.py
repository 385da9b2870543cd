"""Registered promotion gate with its invariants, and quality flags with all classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.flags import quality_flags
from ..operators.gates import gated, leaders, violations
from ..sources.tables import read
from .registry import query

BUILDS = ["Sniper", "Grinder"]
READ = """e AS (SELECT event_id AS id, user_id AS match_id, event_type AS kind, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT match_id, k % 5 AS slot, id, CASE kind WHEN 'click' THEN 'number' WHEN 'view' THEN 'build' WHEN 'purchase' THEN 'gamertag' WHEN 'signup' THEN 'trait' ELSE 'attribute' END AS field,
  CASE kind WHEN 'click' THEN CASE WHEN id % 9 = 0 THEN 'x' ELSE CAST(k + id % 2 * 5 AS VARCHAR) END WHEN 'view' THEN CASE id % 4 WHEN 2 THEN 'Grinder' WHEN 3 THEN 'Other' ELSE 'Sniper' END WHEN 'purchase' THEN CASE WHEN id % 3 = 0 THEN 'Cpu' ELSE 'p' || k % 3 END WHEN 'signup' THEN CASE WHEN id % 5 > 0 THEN 't' || id % 5 END ELSE 'a' || k % 9 END AS v,
  CASE WHEN id % 12 > 0 THEN floor(value) / 128 END AS conf FROM e),
t AS (SELECT match_id, slot, field, v, count(*) AS n, max(coalesce(conf, 0)) AS best, count(*) FILTER (conf >= 0.5) AS strong FROM c GROUP BY 1, 2, 3, 4),
f AS (SELECT t.*, min(id) AS seen FROM t JOIN c ON c.match_id = t.match_id AND c.slot = t.slot AND c.field = t.field AND c.v IS NOT DISTINCT FROM t.v AND coalesce(c.conf, 0) = t.best GROUP BY ALL),
b AS (SELECT *, sum(n) OVER g AS readings, sum(strong) OVER g - strong AS conflicts, lead(best) OVER o AS nb, row_number() OVER o AS r FROM f WINDOW g AS (PARTITION BY match_id, slot, field), o AS (PARTITION BY match_id, slot, field ORDER BY best DESC, seen)),
l AS (SELECT * FROM b WHERE r = 1), sl AS (SELECT match_id, k % 5 AS slot, CASE WHEN max(value) > 90 THEN 'for' WHEN min(value) < 20 THEN 'against' END AS side, bool_or(k % 20 < 3) AS cap FROM e GROUP BY 1, 2),
bad AS (SELECT match_id, slot, field, CASE field WHEN 'number' THEN CASE WHEN try_cast(v AS INTEGER) IS NULL THEN 'not a number' WHEN CAST(v AS INTEGER) > 99 THEN 'no such number' END WHEN 'build' THEN CASE WHEN v = 'Other' THEN 'unknown build' END
  WHEN 'gamertag' THEN CASE WHEN v = 'Cpu' AND NOT EXISTS (SELECT 1 FROM c WHERE c.match_id = l.match_id AND c.slot = l.slot AND c.field IN ('number', 'build', 'trait') AND conf >= 0.5) THEN 'no player''s tag' END END AS why FROM l
  UNION ALL SELECT match_id, slot, field, CASE WHEN field = 'trait' AND count(*) FILTER (v IS NOT NULL AND conf > 0) <> 3 THEN 'traits: ' || count(*) FILTER (v IS NOT NULL AND conf > 0) WHEN field = 'attribute' AND count(*) FILTER (v IS NOT NULL AND conf > 0) < 3 THEN 'attributes: ' || count(*) FILTER (v IS NOT NULL AND conf > 0) END FROM c WHERE field IN ('trait', 'attribute') GROUP BY 1, 2, 3
  UNION ALL SELECT match_id, slot, 'team_side', 'no side' FROM sl WHERE side IS NULL
  UNION ALL SELECT match_id, slot, 'is_captain', 'captains: ' || n FROM (SELECT *, count_if(cap) OVER (PARTITION BY match_id, side) AS n FROM sl) WHERE side IS NOT NULL AND cap AND n > 1)"""
FIELDS = ["number", "build", "gamertag", "trait", "attribute", "team_side", "is_captain"]


def readings(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    i, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    fields = {
        "click": ("number", F.when(i % 9 == 0, "x").otherwise((k + i % 2 * 5).cast("string"))), "view": ("build", F.when(i % 4 == 2, "Grinder").when(i % 4 == 3, "Other").otherwise("Sniper")),
        "purchase": ("gamertag", F.when(i % 3 == 0, "Cpu").otherwise(text("p", k % 3))), "signup": ("trait", F.when(i % 5 > 0, text("t", i % 5))), "error": ("attribute", text("a", k % 9)),
    }
    cell = F.coalesce(*[F.when(kind == n, F.struct(F.lit(f).alias("field"), v.alias("value"))) for n, (f, v) in fields.items()])
    rows = e.select(F.col("user_id").alias("match_id"), (k % 5).alias("slot"), i.alias("evidence_id"), F.when(i % 12 > 0, F.floor("value") / 128).alias("confidence"), cell.alias("c"))
    side = F.when(F.max("value") > 90, "for").when(F.min("value") < 20, "against")
    slots = e.groupBy(F.col("user_id").alias("match_id"), (k % 5).alias("slot")).agg(side.alias("team_side"), F.bool_or(k % 20 < 3).alias("is_captain"))
    return rows.select("match_id", "slot", "evidence_id", "confidence", "c.field", "c.value"), slots


@query(f"WITH {READ} SELECT match_id, slot, field, why AS violation FROM bad WHERE why IS NOT NULL")
def slot_invariants(spark, sf_dir):
    rows, slots = readings(spark, sf_dir)
    return violations(rows, leaders(rows), slots, BUILDS, attributes=3)


@query(f"""WITH {READ}, x AS (SELECT match_id, slot, unnest({FIELDS}) AS field FROM sl), y AS (SELECT match_id, slot, field, min(why) AS why FROM bad WHERE why IS NOT NULL GROUP BY 1, 2, 3), k AS (SELECT match_id, slot, 'build' AS field, 'Sniper' AS known FROM sl WHERE slot = 1),
z AS (SELECT x.match_id, x.slot, x.field, l.v, l.best, coalesce(readings, 0) AS readings, conflicts, why, CASE WHEN readings IS NULL THEN 'unobserved' WHEN why IS NOT NULL THEN 'invalid' WHEN known IS NOT NULL AND known IS DISTINCT FROM l.v THEN 'overruled' WHEN nb >= 0.5 AND best < 1.5 * nb THEN 'contested' ELSE 'promoted' END AS status
  FROM x LEFT JOIN l USING (match_id, slot, field) LEFT JOIN y USING (match_id, slot, field) LEFT JOIN k USING (match_id, slot, field))
SELECT match_id, slot, field, status, CASE WHEN status = 'invalid' THEN why END AS violation, CASE WHEN status = 'promoted' THEN v END AS value, CASE WHEN status = 'promoted' THEN best END AS confidence, CAST(readings AS BIGINT) AS readings, CAST(CASE WHEN status IN ('unobserved', 'invalid') THEN 0 ELSE conflicts END AS BIGINT) AS conflicts FROM z""")
def slot_promotions(spark, sf_dir):
    """Every field of every slot through the six steps; builds of slot 1 are known from elsewhere."""
    rows, slots = readings(spark, sf_dir)
    best = leaders(rows)
    expected = slots.select("match_id", "slot", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    known = slots.filter("slot = 1").select("match_id", "slot", F.lit("build").alias("field"), F.lit("Sniper").alias("known"))
    return gated(expected, best, violations(rows, best, slots, BUILDS, attributes=3), known)


@query("""WITH e AS (SELECT event_id AS id, user_id AS match_id, value, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
v AS (SELECT *, k % 3 AS period, CASE WHEN id % 10 > 0 THEN k % 20 || ':00' END AS clock, CASE WHEN event_type = 'signup' THEN 'faceoff' WHEN event_type = 'error' AND value > 97 THEN 'penalty' ELSE event_type END AS kind, value > 50 AS own, k % 6 > 0 AS tagged, CASE WHEN k % 4 > 0 THEN k % 12 END AS actor, CASE WHEN k % 3 = 0 THEN k % 15 END AS target, CASE WHEN id % 8 > 0 THEN CAST(id * 37 % 1000 AS DECIMAL(10,2)) / 100 END AS x, CAST(k % 50 AS DECIMAL(10,2)) / 10 AS y FROM e),
p AS (SELECT DISTINCT match_id, k % 12 AS player FROM e WHERE value > 30),
a AS (SELECT match_id, 'A' AS flag, 'repeated' AS rule, sum(n - 1) AS n, 5 AS most FROM (SELECT match_id, period, clock, kind, count(*) AS n FROM v WHERE clock IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1 UNION ALL SELECT match_id, 'B', 'unresolved', count_if(own AND tagged AND actor IS NULL), 5 FROM v GROUP BY 1
  UNION ALL SELECT match_id, 'B', 'unread', count_if(NOT tagged AND kind <> 'faceoff'), 1000000000 FROM v GROUP BY 1 UNION ALL SELECT a.match_id, 'C', 'collisions', count(*), 3 FROM v a JOIN v b ON a.match_id = b.match_id AND a.period = b.period AND a.id < b.id AND round(abs(a.x - b.x), 4) <= 1 AND round(abs(a.y - b.y), 4) <= 1 GROUP BY 1
  UNION ALL SELECT match_id, 'D', 'penalties', CASE WHEN count_if(kind = 'penalty') = 0 THEN CAST(floor(max(value)) AS BIGINT) % 7 ELSE 0 END, CASE WHEN count_if(event_type = 'purchase' AND value > 80) > 0 THEN 0 ELSE 1000000000 END FROM v GROUP BY 1
  UNION ALL SELECT match_id, 'G', 'actor', count(*), 0 FROM v WHERE actor IS NOT NULL AND (match_id, actor) NOT IN (SELECT match_id, player FROM p) GROUP BY 1 UNION ALL SELECT match_id, 'G', 'target', count(*), 0 FROM v WHERE target IS NOT NULL AND (match_id, target) NOT IN (SELECT match_id, player FROM p) GROUP BY 1)
SELECT match_id, flag, rule, CAST(n AS BIGINT) AS n, CASE WHEN n > most THEN 'fail' ELSE 'warn' END AS severity FROM a WHERE n > 0""")
def match_flags(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumns({"k": F.from_json("props", "k long")["k"], "match_id": F.col("user_id")})
    i, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    text = lambda n, c: F.when(c, n.cast("string"))
    events = e.select(
        "match_id", (k % 3).alias("period"), text(F.concat((k % 20).cast("string"), F.lit(":00")), i % 10 > 0).alias("clock"), F.when(kind == "signup", "faceoff").when((kind == "error") & (F.col("value") > 97), "penalty").otherwise(kind).alias("kind"),
        F.when(F.col("value") > 50, "for").otherwise("against").alias("side"), text(k, k % 6 > 0).alias("actor_tag"), F.when(k % 4 > 0, k % 12).alias("actor_id"), F.when(k % 3 == 0, k % 15).alias("target_id"),
        F.when(i % 8 > 0, ((i * 37 % 1000).cast("decimal(10,0)") / 100).cast("decimal(8,2)")).alias("x"), ((k % 50).cast("decimal(10,0)") / 10).cast("decimal(8,2)").alias("y"),
    )
    matches = e.groupBy("match_id").agg((F.floor(F.max("value")) % 7).alias("pim"))
    return quality_flags(events, matches, e.filter((kind == "purchase") & (F.col("value") > 80)), e.filter("value > 30").select("match_id", (k % 12).alias("player_id")))
