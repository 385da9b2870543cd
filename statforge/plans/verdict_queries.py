"""Registered consensus and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.verdicts import anchors, faceoffs_verdict, family_promotion, final_gate, goals_verdict, lineup_consensus, match_layers, single_captains
from ..sources.tables import read
from .registry import query

SNAPS = """s AS (SELECT event_id AS id, user_id AS match_id, value > 50 AS side, k % 3 AS position, CASE WHEN event_type IN ('click', 'purchase') THEN 'loadout' ELSE 'lobby' END AS source, 'p' || k % 4 AS gamertag,
  CASE WHEN k % 7 > 0 THEN CAST(k % 10 AS VARCHAR) END AS number, event_type AS build, CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS DECIMAL(18,4)) / 4 END AS conf, CASE WHEN user_id % 2 = 0 AND k % 5 > 0 THEN CAST(k % 5 AS DOUBLE) / 4 END AS sure FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
#: Loadout rows first, then rows of the slot's usual tag, then by the build's confidence, then the newest;
#: the count of fields only where neither tag nor confidence tells.
ANCHORS = """u AS (SELECT match_id, side, position, tag AS usual FROM (SELECT match_id, side, position, regexp_replace(lower(gamertag), '[^a-z0-9]', '', 'g') AS tag, count(*) AS n FROM s GROUP BY 1, 2, 3, 4) WHERE tag <> ''
  QUALIFY row_number() OVER (PARTITION BY match_id, side, position ORDER BY n DESC, tag) = 1),
x AS (SELECT s.*, source = 'loadout' AS own, coalesce(regexp_replace(lower(gamertag), '[^a-z0-9]', '', 'g') = usual, false) AS fits, 1 + CASE WHEN gamertag IS NULL THEN 0 ELSE 1 END + CASE WHEN number IS NULL THEN 0 ELSE 1 END AS n FROM s LEFT JOIN u USING (match_id, side, position)),
y AS (SELECT * FROM (SELECT *, bool_or(own) OVER g AS any_own FROM x WINDOW g AS (PARTITION BY match_id, side, position)) WHERE own OR NOT any_own),
z AS (SELECT * FROM (SELECT *, bool_or(fits) OVER g AS any_fits FROM y WINDOW g AS (PARTITION BY match_id, side, position)) WHERE fits OR NOT any_fits),
a AS (SELECT match_id, side, position, id AS anchor FROM (SELECT *, bool_or(sure IS NOT NULL) OVER g AS any_sure FROM z WINDOW g AS (PARTITION BY match_id, side, position))
  QUALIFY row_number() OVER (PARTITION BY match_id, side, position ORDER BY CASE WHEN any_sure THEN sure END DESC NULLS LAST, CASE WHEN any_sure OR any_fits THEN id END DESC, n DESC, id) = 1)"""


def snapshots(spark, sf_dir):
    k = F.col("k")
    e = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    conf = F.when(k % 5 > 0, k % 5 / 4)
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), (F.col("value") > 50).alias("side"), (k % 3).alias("position"), F.when(F.col("event_type").isin("click", "purchase"), "loadout").otherwise("lobby").alias("source"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("gamertag"), F.when(k % 7 > 0, (k % 10).cast("string")).alias("number"), F.col("event_type").alias("build"), F.when(F.col("user_id") % 2 == 0, conf).alias("sure"), *[conf.alias(f"conf_{f}") for f in ("gamertag", "number", "build")],
    )


@query(f"""WITH {SNAPS}, {ANCHORS}, l AS (SELECT match_id, side, position, id, source, 'gamertag' AS field, gamertag AS v, conf FROM s UNION ALL SELECT match_id, side, position, id, source, 'number', number, conf FROM s UNION ALL SELECT match_id, side, position, id, source, 'build', build, conf FROM s),
f AS (SELECT *, bool_or(source = 'loadout') OVER (PARTITION BY match_id, side, position, field) AS own FROM l WHERE v IS NOT NULL),
t AS (SELECT match_id, side, position, field, v, sum(coalesce(conf, 1)) AS w, min(CASE WHEN id = anchor THEN -1 ELSE id END) AS seen FROM f JOIN a USING (match_id, side, position) WHERE field = 'build' OR NOT own OR source = 'loadout' GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY match_id, side, position, field ORDER BY w DESC, seen) = 1)
SELECT match_id, side, position, anchor, max(v) FILTER (field = 'gamertag') AS gamertag, max(v) FILTER (field = 'number') AS number, max(v) FILTER (field = 'build') AS build FROM a LEFT JOIN b USING (match_id, side, position) GROUP BY 1, 2, 3, 4""")
def lineup_votes(spark, sf_dir):
    return lineup_consensus(snapshots(spark, sf_dir), ["match_id", "side", "position"], ["gamertag", "number", "build"], ["gamertag", "number"], "sure")


@query(f"""WITH {SNAPS}, {ANCHORS}, d AS (SELECT match_id, side, position, gamertag, number, CASE WHEN id = anchor THEN build END AS build, id, conf FROM s JOIN a USING (match_id, side, position)),
o AS (SELECT match_id, side, gamertag, min(position) AS position, arg_min(number, id) FILTER (number IS NOT NULL) AS number, arg_min(build, id) FILTER (build IS NOT NULL) AS build, CAST(max(conf) AS DOUBLE) AS star, count(*) AS frames FROM d GROUP BY 1, 2, 3)
SELECT match_id, side, gamertag, position, number, build, frames, coalesce(star >= 0.75, false) AND row_number() OVER (PARTITION BY match_id, side ORDER BY star DESC NULLS LAST, gamertag) = 1 AS is_captain FROM o""")
def lineup_read_model(spark, sf_dir):
    """A player once a side, details from the first frame that has them, one captain."""
    s = snapshots(spark, sf_dir)
    slot = ["match_id", "side", "position"]
    a = anchors(s, slot, ["gamertag", "number", "build"], "sure")
    d = s.join(a, slot).withColumn("build", F.when(F.col("id") == F.col("anchor"), F.col("build")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    o = d.groupBy("match_id", "side", "gamertag").agg(F.min("position").alias("position"), first("number"), first("build"), F.max("conf_gamertag").alias("star"), F.count("*").alias("frames"))
    return single_captains(o, ["match_id", "side"], "star", "gamertag", 0.75).drop("star")


PERIODS = """p AS (SELECT o_orderkey AS match_id, CASE WHEN o_orderpriority <> '5-LOW' THEN 3 + o_custkey % 2 END AS bound, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.5 ELSE 1.0 END AS coverage,
  CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 0.5 ELSE 1.0 END AS accuracy, CASE WHEN o_orderstatus = 'P' THEN 1 END AS beyond, CASE WHEN o_totalprice > 50000 THEN o_totalprice > 250000 END AS vacuous, o_orderkey % 2 = 0 AS forced, o_orderkey % 7 <> 0 AS complete FROM orders)"""


def periods(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        n.alias("match_id"), F.when(F.col("o_orderpriority") != "5-LOW", 3 + c % 2).alias("bound"), F.when(n % 5 == 0, None).when(n % 5 == 1, 0.5).otherwise(1.0).alias("coverage"), F.when(c % 6 == 0, None).when(c % 6 == 1, 0.5).otherwise(1.0).alias("accuracy"),
        F.when(F.col("o_orderstatus") == "P", 1).alias("beyond"), F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice") > 250000).alias("vacuous"), (n % 2 == 0).alias("forced"), (n % 7 != 0).alias("complete"),
    )


VERDICTS = """v AS (SELECT *, CASE WHEN bound IS NULL OR coverage IS NULL THEN 'not_applicable' WHEN coverage < 1 THEN 'review' WHEN accuracy IS NULL THEN 'not_applicable' WHEN accuracy <> 1 OR beyond > 0 OR (vacuous AND NOT forced) THEN 'review' ELSE 'reconciled' END AS goals,
  CASE WHEN bound IS NULL THEN 'no bound' WHEN coverage IS NULL THEN 'no readings' WHEN coverage < 1 THEN 'coverage' WHEN vacuous IS NULL THEN 'no truth' WHEN accuracy IS NULL THEN 'not gradable' WHEN accuracy <> 1 THEN 'accuracy' WHEN NOT forced THEN 'uncontested' ELSE 'promote' END AS faceoffs FROM p)"""


def period_rows(spark, sf_dir):
    p = periods(spark, sf_dir)
    goals = goals_verdict(F.col("bound"), F.col("coverage"), F.col("accuracy"), F.col("beyond"), F.col("vacuous"), F.col("forced"))
    faceoffs = faceoffs_verdict(F.col("bound"), F.col("coverage"), F.col("vacuous").isNotNull(), F.col("accuracy"), F.col("forced"))
    return p.withColumns({"goals": goals, "faceoffs": faceoffs})


@query(f"WITH {PERIODS}, {VERDICTS} SELECT match_id, goals, faceoffs FROM v")
def period_verdicts(spark, sf_dir):
    return period_rows(spark, sf_dir).select("match_id", "goals", "faceoffs")


@query(f"""WITH {PERIODS}, {VERDICTS}, f AS (SELECT match_id, 'goals' AS family, goals AS verdict, * EXCLUDE (match_id, goals, faceoffs) FROM v UNION ALL SELECT match_id, 'faceoffs', faceoffs, * EXCLUDE (match_id, goals, faceoffs) FROM v UNION ALL SELECT match_id, 'shots', 'review', * EXCLUDE (match_id, goals, faceoffs) FROM v)
SELECT match_id, family, CASE WHEN family = 'shots' THEN 'rejected: shots' WHEN bound IS DISTINCT FROM 3 THEN 'rejected: bound' WHEN beyond = 1 THEN 'rejected: extraction' WHEN verdict NOT IN ('reconciled', 'promote') THEN 'held: verdict' WHEN NOT complete THEN 'held: incomplete' ELSE 'promoted' END AS outcome FROM f""")
def promoted_families(spark, sf_dir):
    v = period_rows(spark, sf_dir)
    families = F.array(*[F.struct(F.lit(n).alias("family"), c.alias("verdict")) for n, c in (("goals", F.col("goals")), ("faceoffs", F.col("faceoffs")), ("shots", F.lit("review")))])
    rows = v.select("*", F.inline(families))
    status = F.when(F.col("beyond") == 1, "rejected").otherwise("reviewed")
    return rows.select("match_id", "family", family_promotion(F.col("family"), F.lit(3).cast("long"), F.col("bound"), status, F.col("verdict"), F.col("complete")).alias("outcome"))


@query(f"WITH {PERIODS} SELECT match_id, CASE WHEN accuracy = 1 THEN 'PASS' WHEN accuracy IS NOT NULL THEN 'HOLD' WHEN NOT forced THEN 'OPERATOR_CONFIRM' ELSE 'HOLD' END AS gate FROM p")
def final_gates(spark, sf_dir):
    return periods(spark, sf_dir).select("match_id", final_gate(F.col("accuracy"), F.col("forced")).alias("gate"))


@query("""WITH e AS (SELECT l_orderkey AS k, count_if(l_linestatus = 'F') AS n, count_if(l_linestatus = 'F' AND l_discount > 0.01) AS ok FROM lineitem GROUP BY 1),
d AS (SELECT k, sum(n - 1) AS off FROM (SELECT l_orderkey AS k, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
s AS (SELECT l_orderkey AS k, sum(2 + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS filled, 4 * count(*) AS fields FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
t AS (SELECT k, sum(least(1.0, CAST(actual AS DOUBLE) / expected) * weight) AS got, sum(weight) AS total FROM (SELECT o_orderkey AS k, o_custkey % 4 AS actual, CASE WHEN o_orderstatus <> 'P' THEN 3 END AS expected, 2 AS weight FROM orders UNION ALL SELECT o_orderkey, 1, 2, 1 FROM orders) WHERE expected > 0 GROUP BY 1),
j AS (SELECT coalesce(e.k, s.k, t.k) AS match_id, CASE WHEN n > 0 THEN greatest(0.0, CAST(ok - coalesce(off, 0) AS DOUBLE) / n) ELSE 0.0 END AS a, CASE WHEN fields > 0 THEN CAST(filled AS DOUBLE) / fields ELSE 0.0 END AS b, CASE WHEN total > 0 THEN got / total ELSE 0.0 END AS c
      FROM e LEFT JOIN d USING (k) FULL JOIN s ON s.k = e.k FULL JOIN t ON t.k = coalesce(e.k, s.k))
SELECT match_id, 'events' AS layer, a AS score, a >= 0.9 AS passed FROM j UNION ALL SELECT match_id, 'lineup', b, b >= 0.9 FROM j UNION ALL SELECT match_id, 'completeness', c, c >= 0.95 FROM j""")
def quality_scores(spark, sf_dir):
    x, o = read(spark, sf_dir, "lineitem").withColumn("match_id", F.col("l_orderkey")), read(spark, sf_dir, "orders").withColumn("match_id", F.col("o_orderkey"))
    events = x.select("match_id", F.when(F.col("l_linestatus") == "F", "for").otherwise("against").alias("side"), F.when(F.col("l_discount") > 0.01, F.col("l_suppkey")).alias("actor_id"))
    doubled = x.groupBy("match_id", "l_linenumber").agg((F.count("*") - 1).alias("n")).filter("n > 0")
    slots = x.filter("l_returnflag <> 'R'").select("match_id", F.array(F.lit("tag"), F.lit("persona"), F.when(F.col("l_tax") > 0.04, "C"), F.lit("")).alias("fields"))
    kept = o.select("match_id", (F.col("o_custkey") % 4).alias("actual"), F.when(F.col("o_orderstatus") != "P", 3).alias("expected"), F.lit(2).alias("weight"))
    tables = kept.unionByName(o.select("match_id", F.lit(1).cast("long").alias("actual"), F.lit(2).alias("expected"), F.lit(1).alias("weight")))
    return match_layers(events, doubled, slots, tables, "match_id")
