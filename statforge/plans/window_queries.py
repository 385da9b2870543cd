"""Registered windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_seconds
from ..operators.windows import before_average, minmax_score, ordinal, recent, running_lead, streaks
from ..sources.tables import EVENTS, MATCHES, PLAYERS, events, matches, player_matches, read
from .registry import query


@query(f"WITH {MATCHES} SELECT match_id, count(*) OVER (PARTITION BY title ORDER BY played_at) AS season_number, count(*) OVER (PARTITION BY title, opponent_id ORDER BY played_at) AS meeting FROM matches")
def ordinal_in_title(spark, sf_dir):
    return matches(spark, sf_dir).select("match_id", ordinal(["title"], "played_at").alias("season_number"), ordinal(["title", "opponent_id"], "played_at").alias("meeting"))


@query(f"""WITH {MATCHES}, t AS (SELECT opponent_id, played_at, min(match_id) AS id FROM matches GROUP BY 1, 2),
n AS (SELECT *, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM t WINDOW w AS (PARTITION BY opponent_id ORDER BY played_at))
SELECT match_id, previous_id, next_id FROM matches JOIN n USING (opponent_id, played_at)""")
def prev_next(spark, sf_dir):
    from ..operators.joins import neighbours

    return neighbours(matches(spark, sf_dir), ["opponent_id"], "played_at", "match_id").select("match_id", "previous_id", "next_id")


@query(f"""WITH {MATCHES}, s AS (SELECT *, CAST(epoch(played_at) AS BIGINT) AS t FROM matches)
SELECT match_id, CAST(sum(score) OVER w AS DOUBLE) / nullif(count(score) OVER w, 0) AS average_before FROM s WINDOW w AS (PARTITION BY opponent_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def season_to_date_avg(spark, sf_dir):
    m = matches(spark, sf_dir).withColumn("t", epoch_seconds(F.col("played_at")))
    return m.select("match_id", before_average(["opponent_id"], "t", "score").alias("average_before"))


TOTALS = f"{PLAYERS}, t AS (SELECT player_id, player_id % 3 AS team, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(saves) AS BIGINT) AS saves FROM pm GROUP BY 1)"


def totals(spark, sf_dir):
    return player_matches(spark, sf_dir).groupBy("player_id").agg(F.sum("goals").alias("goals"), F.sum("saves").alias("saves")).withColumn("team", F.col("player_id") % 3)


@query(f"WITH {TOTALS} SELECT player_id, rank() OVER (PARTITION BY team ORDER BY goals DESC) AS rank, count(*) OVER (PARTITION BY team) AS n, goals - CAST(sum(goals) OVER (PARTITION BY team) AS DOUBLE) / count(*) OVER (PARTITION BY team) AS diff FROM t WHERE goals IS NOT NULL")
def competition_rank(spark, sf_dir):
    w = Window.partitionBy("team")
    n = F.count("*").over(w)
    return totals(spark, sf_dir).filter("goals IS NOT NULL").select(
        "player_id", F.rank().over(w.orderBy(F.desc("goals"))).cast("long").alias("rank"), n.alias("n"), (F.col("goals") - F.sum("goals").over(w).cast("double") / n).alias("diff")
    )


@query(f"""WITH {TOTALS}, r AS (SELECT *, min(goals) OVER w AS lo, max(goals) OVER w AS hi, count(goals) OVER w AS n FROM t WINDOW w AS (PARTITION BY team))
SELECT player_id, CASE WHEN n >= 2 THEN CASE WHEN hi = lo THEN 50.0 ELSE 100 * (CAST(goals - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)) END END AS score,
  CASE WHEN 2 * goals >= hi THEN 'high' WHEN 10 * goals >= hi THEN 'mid' WHEN goals > 0 THEN 'low' ELSE 'none' END AS band FROM r""")
def minmax_norm(spark, sf_dir):
    w = Window.partitionBy("team")
    g, top = F.col("goals"), F.max("goals").over(w)
    band = F.when(2 * g >= top, "high").when(10 * g >= top, "mid").when(g > 0, "low").otherwise("none")
    return totals(spark, sf_dir).select("player_id", minmax_score(g, w).alias("score"), band.alias("band"))


@query(f"""WITH {EVENTS}, e AS (SELECT event_id, user_id, event_type = 'click' AS side FROM ev WHERE event_type IN ('click', 'view')),
r AS (SELECT *, CAST(sum(CAST(side AS INTEGER)) OVER w AS BIGINT) AS ours, CAST(sum(CAST(NOT side AS INTEGER)) OVER w AS BIGINT) AS theirs FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT *, CAST(sign(ours - theirs) AS BIGINT) AS lead FROM r),
b AS (SELECT *, coalesce(lag(lead) OVER w, 0) AS lead_before, coalesce(bool_or(lead > 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS led FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY event_id) AS k, count_if(side) OVER (PARTITION BY user_id) AS a, count_if(NOT side) OVER (PARTITION BY user_id) AS o FROM b)
SELECT event_id, ours, theirs, lead, lead_before, lead > 0 AND lead_before <= 0 AND led AS reclaims, a <> o AND side = (a > o) AND k = least(a, o) + 1 AS winner FROM z""")
def running_lead_events(spark, sf_dir):
    e = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view")).select("event_id", "user_id", (F.col("event_type") == "click").alias("side"))
    out = running_lead(e, ["user_id"], "event_id", F.col("side"))
    u = Window.partitionBy("user_id")
    a, o = F.count_if("side").over(u), F.count_if(~F.col("side")).over(u)
    k = F.row_number().over(Window.partitionBy("user_id", "side").orderBy("event_id"))
    return out.select("event_id", "ours", "theirs", "lead", "lead_before", "reclaims", ((a != o) & (F.col("side") == (a > o)) & (k == F.least(a, o) + 1)).alias("winner"))


@query(f"""WITH {MATCHES}, s AS (SELECT opponent_id, played_at, match_id, CASE WHEN result = 'DNF' THEN 'LOSS' ELSE result END AS result FROM matches), r AS (SELECT opponent_id, result, row_number() OVER w AS n, first(result) OVER w AS f FROM s WINDOW w AS (PARTITION BY opponent_id ORDER BY played_at DESC, match_id DESC))
SELECT opponent_id, max(f) AS state, coalesce(min(CASE WHEN result <> f THEN n END), count(*) + 1) - 1 AS streak FROM r GROUP BY 1""")
def current_streak(spark, sf_dir):
    m = matches(spark, sf_dir).withColumn("result", F.when(F.col("result") == "DNF", "LOSS").otherwise(F.col("result")))
    return streaks(m, ["opponent_id"], [F.desc("played_at"), F.desc("match_id")], "result")


@query(f"""WITH {MATCHES}, r AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY opponent_id ORDER BY played_at DESC, match_id DESC) <= 5)
SELECT opponent_id, count(*) AS n, CAST(sum(score) AS DOUBLE) AS total, arg_max(match_id, (score, -match_id)) AS best_match FROM r GROUP BY 1""")
def recent_n_best(spark, sf_dir):
    r = recent(matches(spark, sf_dir), ["opponent_id"], [F.desc("played_at"), F.desc("match_id")], 5)
    return r.groupBy("opponent_id").agg(F.count("*").alias("n"), F.sum("score").cast("double").alias("total"), F.max_by("match_id", F.struct("score", -F.col("match_id"))).alias("best_match"))


@query(f"""WITH {PLAYERS}, n AS (SELECT match_id, player_id, row_number() OVER (PARTITION BY match_id ORDER BY goals DESC, player_id) AS k FROM pm WHERE NOT is_goalie)
SELECT match_id, player_id, CASE k WHEN 1 THEN 'LD' WHEN 2 THEN 'RD' END AS slot FROM n""")
def slot_by_order(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("goals"), "player_id"))
    return player_matches(spark, sf_dir).filter(~F.col("is_goalie")).select("match_id", "player_id", F.when(k == 1, "LD").when(k == 2, "RD").alias("slot"))


@query("""WITH v AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, lead(n) OVER w AS below FROM v WINDOW w AS (PARTITION BY source ORDER BY n DESC, lang))
SELECT source, lang, n - coalesce(below, 0) AS gap, below IS NULL OR 2 * n >= 3 * below AS dominant FROM r WHERE k = 1""")
def dominance_gate(spark, sf_dir):
    v = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), F.asc("lang"))
    r = v.withColumns({"k": F.row_number().over(w), "below": F.lead("n").over(w)}).filter("k = 1")
    return r.select("source", "lang", (F.col("n") - F.coalesce("below", F.lit(0))).alias("gap"), (F.col("below").isNull() | (2 * F.col("n") >= 3 * F.col("below"))).alias("dominant"))


@query("""WITH c AS (SELECT o_custkey, o_orderdate, o_orderpriority, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS p FROM (SELECT o_custkey, o_orderdate, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1, 2)),
k AS (SELECT * FROM c WHERE p IS NULL OR p <> o_orderpriority)
SELECT o_custkey AS player_id, o_orderpriority AS tag, epoch(o_orderdate)::BIGINT AS seen_from, epoch(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))::BIGINT AS seen_until FROM k""")
def scd2(spark, sf_dir):
    from ..sources.tables import history

    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player_id"), F.col("o_orderdate").alias("at")).agg(F.min("o_orderpriority").alias("tag"))
    h = history(o, "player_id", "tag", "at")
    return h.select("player_id", "tag", epoch_seconds(F.col("seen_from")).alias("seen_from"), epoch_seconds(F.col("seen_until")).alias("seen_until"))
