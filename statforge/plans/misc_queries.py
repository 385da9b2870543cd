"""Registered sorts, filters, scalars and sequence operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import elapsed, epoch_seconds, from_epoch, mm_ss, repaired, seconds_of
from ..functions.text import plain_tag, prefix_key, similarity, snapshot_name
from ..operators.classify import fitted
from ..operators.clusters import median_clusters
from ..operators.decoding import best_paths, class_log_probs, decoded, emissions, units
from ..operators.matching import nearest_assignment
from ..operators.segments import hysteresis_segments
from ..operators.sequences import collision_groups, reel_groups
from ..sources.tables import EVENTS, MATCHES, events, matches, read
from .registry import query


@query(f"WITH {MATCHES} SELECT match_id, CAST(score AS DOUBLE) AS score FROM matches ORDER BY played_at DESC, match_id DESC LIMIT 20 OFFSET 20")
def paging(spark, sf_dir):
    return matches(spark, sf_dir).orderBy(F.desc("played_at"), F.desc("match_id")).offset(20).limit(20).select("match_id", F.col("score").cast("double").alias("score"))


@query(f"WITH {MATCHES} SELECT opponent_id, CAST(sum(score) AS DOUBLE) AS total FROM matches GROUP BY 1 ORDER BY sum(score) DESC, opponent_id LIMIT 5")
def topk_leaders(spark, sf_dir):
    t = matches(spark, sf_dir).groupBy("opponent_id").agg(F.sum("score").alias("t"))
    return t.orderBy(F.desc("t"), F.asc("opponent_id")).limit(5).select("opponent_id", F.col("t").cast("double").alias("total"))


@query(f"""WITH {MATCHES} SELECT match_id, row_number() OVER (PARTITION BY title ORDER BY mode DESC NULLS FIRST, match_id) AS desc_first, row_number() OVER (PARTITION BY title ORDER BY mode DESC NULLS LAST, match_id) AS desc_last,
row_number() OVER (PARTITION BY title ORDER BY mode ASC NULLS LAST, match_id) AS asc_last FROM matches""")
def nulls_order(spark, sf_dir):
    rank = lambda c: F.row_number().over(Window.partitionBy("title").orderBy(c, "match_id")).cast("long")
    return matches(spark, sf_dir).select("match_id", rank(F.desc_nulls_first("mode")).alias("desc_first"), rank(F.desc_nulls_last("mode")).alias("desc_last"), rank(F.asc_nulls_last("mode")).alias("asc_last"))


@query(f"""WITH {MATCHES} SELECT match_id, mode IS NOT DISTINCT FROM '1-URGENT' AS urgent, mode IS NULL AS all_modes FROM matches WHERE title = 1996 AND result IN ('WIN', 'OTL') AND opponent_id IN (SELECT c_custkey FROM customer WHERE c_name ILIKE '%er#0000000%')""")
def filter_builder(spark, sf_dir):
    wanted = [F.col("title") == 1996, F.col("result").isin("WIN", "OTL")]
    m = matches(spark, sf_dir).filter(reduce(lambda a, b: a & b, wanted))
    named = read(spark, sf_dir, "customer").filter(F.col("c_name").ilike("%er#0000000%")).select(F.col("c_custkey").alias("opponent_id"))
    return m.join(named, "opponent_id", "left_semi").select("match_id", F.col("mode").eqNullSafe("1-URGENT").alias("urgent"), F.col("mode").isNull().alias("all_modes"))


@query("""WITH c AS (SELECT event_id, lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 7 % 70 AS VARCHAR), 2, '0') AS clock, CAST(event_id % 25 * 60 + event_id * 7 % 70 AS BIGINT) AS s, event_id * 7 % 70 AS ss,
  epoch(ts)::BIGINT AS e FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events))
SELECT event_id, s AS seconds, CASE WHEN s <= 1200 AND ss < 60 THEN 1200 - s END AS elapsed, lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS text, e AS from_seconds, e AS from_millis, clock AS repaired FROM c""")
def clock_fns(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("e", epoch_seconds(F.date_trunc("second", "ts")))
    n = F.col("event_id")
    clock = F.concat(F.lpad((n % 25).cast("string"), 2, "0"), F.lit(":"), F.lpad((n * 7 % 70).cast("string"), 2, "0"))
    e = e.withColumn("clock", clock)
    noisy = F.translate("clock", "08", "OB")
    return e.select("event_id", seconds_of(F.col("clock")).cast("long").alias("seconds"), elapsed(F.col("clock")).cast("long").alias("elapsed"), mm_ss(seconds_of(F.col("clock"))).alias("text"), epoch_seconds(from_epoch(F.col("e"))).alias("from_seconds"), epoch_seconds(from_epoch(F.col("e") * 1000)).alias("from_millis"), repaired(noisy).alias("repaired"))


@query("""SELECT l_suppkey AS player_id, l_orderkey AS match_id, l_linenumber, CAST(l_quantity AS BIGINT) * 3 + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END AS score,
CASE WHEN l_quantity >= 45 THEN 'sniper' WHEN l_discount >= 0.08 AND l_quantity >= 20 THEN 'playmaker' WHEN l_returnflag = 'R' THEN 'grinder' ELSE 'balanced' END AS archetype FROM lineitem""")
def score_weights(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    score = q * 3 + F.when(F.col("l_returnflag") == "R", 5).otherwise(0) - F.when(F.col("l_linestatus") == "O", 2).otherwise(0)
    kind = F.when(q >= 45, "sniper").when((F.col("l_discount") >= 0.08) & (q >= 20), "playmaker").when(F.col("l_returnflag") == "R", "grinder").otherwise("balanced")
    return x.select(F.col("l_suppkey").alias("player_id"), F.col("l_orderkey").alias("match_id"), "l_linenumber", score.alias("score"), kind.alias("archetype"))


@query("""WITH n AS (SELECT p_partkey, '-.' || p_name || ' (' || p_brand || ').' AS shown, p_name FROM part)
SELECT p_partkey, regexp_replace(lower(shown), '[^a-z0-9]', '', 'g') AS tag, substr(regexp_replace(lower(shown), '[^a-z]', '', 'g'), 1, 4) AS prefix, p_name AS plain, 1 - CAST(levenshtein(p_name, 'cold widget') AS DOUBLE) / greatest(length(p_name), 11) AS near FROM n""")
def normalise_tag(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("shown", F.concat(F.lit("-."), "p_name", F.lit(" ("), "p_brand", F.lit(").")))
    return p.select("p_partkey", plain_tag(F.col("shown")).alias("tag"), prefix_key(F.col("shown")).alias("prefix"), snapshot_name(F.col("shown")).alias("plain"), similarity(F.col("p_name"), F.lit("cold widget")).alias("near"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even, sha256(props) AS digest FROM events""")
def json_fields(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.get_json_object("props", "$.absent").alias("absent"), (k % 2 == 0).alias("even"), F.sha2("props", 256).alias("digest"))


@query(f"""WITH {MATCHES}, s AS (SELECT opponent_id, title > 1996 AS late, CAST(count_if(result = 'WIN') AS DOUBLE) / count(*) AS pct, count(*) AS gp FROM matches GROUP BY 1, 2)
SELECT a.opponent_id, a.pct - b.pct AS delta, a.gp AS gp FROM s a JOIN s b ON a.opponent_id = b.opponent_id AND a.late AND NOT b.late""")
def delta_sort(spark, sf_dir):
    late = F.col("title") > 1996
    part = lambda c: F.count_if(c & (F.col("result") == "WIN")).cast("double") / F.nullif(F.count_if(c), F.lit(0).cast("long"))
    s = matches(spark, sf_dir).groupBy("opponent_id").agg((part(late) - part(~late)).alias("delta"), F.count_if(late).cast("long").alias("gp"))
    return s.filter("delta IS NOT NULL").orderBy(F.desc("delta"), F.desc("gp"), "opponent_id")


@query(f"""WITH {EVENTS}, t AS (SELECT user_id, count_if(event_type = 'view') AS v, count_if(event_type = 'click' AND value > 30) AS c, count_if(event_type = 'purchase' AND value > 90) AS p FROM ev GROUP BY 1),
n AS (SELECT user_id, v, nullif(c, 0) AS c, nullif(p, 0) AS p FROM t)
SELECT user_id, CASE WHEN c IS NOT NULL AND p IS NOT NULL THEN (v + 2 * c + 3 * p) / CAST(6 AS DOUBLE) WHEN c IS NOT NULL THEN (v + 2 * c) / CAST(3 AS DOUBLE) WHEN p IS NOT NULL THEN (v + 3 * p) / CAST(4 AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS edge FROM n""")
def possession_tiers(spark, sf_dir):
    n = lambda c: F.nullif(F.count_if(c).cast("long"), F.lit(0).cast("long"))
    kind, value = F.col("event_type"), F.col("value")
    t = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind == "view").alias("v"), n((kind == "click") & (value > 30)).alias("c"), n((kind == "purchase") & (value > 90)).alias("p"))
    v, c, p = F.col("v"), F.col("c"), F.col("p")
    edge = F.when(c.isNotNull() & p.isNotNull(), (v + 2 * c + 3 * p) / 6.0).when(c.isNotNull(), (v + 2 * c) / 3.0).when(p.isNotNull(), (v + 3 * p) / 4.0).otherwise(v.cast("double"))
    return t.select("user_id", edge.alias("edge"))


@query("""WITH p AS (SELECT o_custkey AS opponent_id, CAST(o_orderkey AS HUGEINT) AS x, CAST(floor(o_totalprice) AS HUGEINT) AS y FROM orders),
s AS (SELECT opponent_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM p GROUP BY 1)
SELECT opponent_id, n, CAST(n * sxy - sx * sy AS DOUBLE) / CAST(n * sxx - sx * sx AS DOUBLE) AS slope FROM s WHERE n * sxx - sx * sx > 0""")
def axis_fit(spark, sf_dir):
    """Least squares in whole numbers, so that the order of summing does not matter."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    p = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("opponent_id"), F.col("o_orderkey").alias("x"), F.floor("o_totalprice").alias("y"))
    s = p.groupBy("opponent_id").agg(F.count("*").alias("n"), *[F.sum(c).cast("decimal(19,0)").alias(n) for n, c in (("sx", wide("x")), ("sy", wide("y")), ("sxy", wide("x") * wide("y")), ("sxx", wide("x") * wide("x")))])
    den = F.expr("n * sxx - sx * sx")
    return s.filter(den > 0).select("opponent_id", "n", (F.expr("n * sxy - sx * sy").cast("double") / den.cast("double")).alias("slope"))


SCREENS = """fr AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'menu' WHEN event_type IN ('purchase', 'signup') THEN 'play' ELSE 'unknown' END AS state, CAST(event_id AS DOUBLE) AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"""


def frames(spark, sf_dir):
    kind = F.col("event_type")
    state = F.when(kind.isin("click", "view"), "menu").when(kind.isin("purchase", "signup"), "play").otherwise("unknown")
    return events(spark, sf_dir).withColumns({"state": state, "seconds": F.col("event_id").cast("double")})


@query(f"""WITH RECURSIVE {SCREENS},
look AS (SELECT *, state <> 'unknown' AND lead(state) OVER w IS NOT DISTINCT FROM state AND (state = 'play' OR lead(state, 2) OVER w IS NOT DISTINCT FROM state) AS opens, lead(t) OVER w AS after FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
walk AS (SELECT user_id, i, CASE WHEN opens THEN state END AS open_, CASE WHEN opens THEN i END AS first, CASE WHEN opens THEN i END AS last, 0 AS k FROM look WHERE i = 1
  UNION ALL SELECT l.user_id, l.i, CASE WHEN w.open_ = l.state OR (w.open_ IS NOT NULL AND k < 1) THEN w.open_ WHEN opens THEN l.state END,
    CASE WHEN w.open_ = l.state OR (w.open_ IS NOT NULL AND k < 1) THEN first WHEN opens THEN l.i END,
    CASE WHEN w.open_ = l.state THEN l.i WHEN w.open_ IS NOT NULL AND k < 1 THEN last WHEN opens THEN l.i END, CASE WHEN w.open_ IS NOT NULL AND w.open_ <> l.state AND k < 1 THEN k + 1 ELSE 0 END
  FROM walk w JOIN look l ON l.user_id = w.user_id AND l.i = w.i + 1),
s AS (SELECT user_id, first, max(open_) AS state, max(last) AS last FROM walk WHERE open_ IS NOT NULL GROUP BY 1, 2)
SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY s.first) - 1 AS segment, s.state, a.t AS first_s, b.t AS last_s, coalesce(b.after, b.t + 1) AS end_s, s.last - s.first + 1 AS frames
FROM s JOIN look a ON a.user_id = s.user_id AND a.i = s.first JOIN look b ON b.user_id = s.user_id AND b.i = s.last WHERE coalesce(b.after, b.t + 1) - a.t >= CASE s.state WHEN 'menu' THEN 3 ELSE 200 END""")
def segment_hysteresis(spark, sf_dir):
    """Two equal frames open play, three the menu; play shorter than 200 s is dropped."""
    return hysteresis_segments(frames(spark, sf_dir), "user_id", "event_id", "state", "seconds", ["menu", "play"], opening_by={"play": 2}, shortest_by={"play": 200.0})


_STAY, _MOVE, _HIT, _MISS, _FIRST = (int(x) for x in units(np.log([0.9, 0.1, 0.8, 0.2, 0.5])))


@query(f"""WITH RECURSIVE {SCREENS}, e AS (SELECT *, CASE state WHEN 'menu' THEN {_HIT} WHEN 'play' THEN {_MISS} ELSE 0 END AS e0, CASE state WHEN 'menu' THEN {_MISS} WHEN 'play' THEN {_HIT} ELSE 0 END AS e1 FROM fr),
fw AS (SELECT user_id, i, {_FIRST} + e0 AS v0, {_FIRST} + e1 AS v1, 0 AS b0, 0 AS b1 FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, greatest(v0 + {_STAY}, v1 + {_MOVE}) + e0, greatest(v0 + {_MOVE}, v1 + {_STAY}) + e1, CASE WHEN v1 + {_MOVE} > v0 + {_STAY} THEN 1 ELSE 0 END, CASE WHEN v1 + {_STAY} > v0 + {_MOVE} THEN 1 ELSE 0 END
  FROM fw JOIN e ON e.user_id = fw.user_id AND e.i = fw.i + 1),
bw AS (SELECT user_id, max(i) AS i, CASE WHEN arg_max(v1, i) > arg_max(v0, i) THEN 1 ELSE 0 END AS s FROM fw GROUP BY 1
  UNION ALL SELECT bw.user_id, bw.i - 1, CASE bw.s WHEN 0 THEN fw.b0 ELSE fw.b1 END FROM bw JOIN fw ON fw.user_id = bw.user_id AND fw.i = bw.i WHERE bw.i > 1)
SELECT e.user_id, e.event_id, e.state AS observed, CASE s WHEN 0 THEN 'menu' ELSE 'play' END AS decoded FROM e JOIN bw ON bw.user_id = e.user_id AND bw.i = e.i""")
def viterbi_states(spark, sf_dir):
    return decoded(frames(spark, sf_dir), "user_id", "event_id", "state", ["menu", "play"], stay=0.9, hit=0.8)


@query()
def screen_paths(spark, sf_dir):
    """Frames of each user decoded from a classifier's log probabilities, an anchor for high
    values in play, and frames that are rejected; fitted on the frames of four users in five."""
    e = frames(spark, sf_dir).withColumns({"value": F.coalesce(F.col("value"), F.lit(0.0)), "hour": F.hour("ts").cast("double"), "k": F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0))})
    states = ["menu", "play", "unknown"]
    scored = class_log_probs(fitted(e.filter("user_id % 5 <> 0"), "state", ["value", "hour", "k"]), e, states)
    emit = emissions(states, F.col("log_probs"), {"play": (F.col("value") > 90).cast("int")}, F.col("event_type") == "error", "unknown")
    move = np.log([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.25, 0.25, 0.5]])
    return best_paths(scored.withColumn("observed", F.col("state")), "user_id", "event_id", "observed", emit, move, np.log([0.4, 0.1, 0.5]), states)


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, event_type = 'signup' AS o, event_type = 'error' AS c, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ev),
r AS (SELECT *, sum(CASE WHEN (o AND b <> 'signup') OR (NOT c AND b = 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS reel FROM s)
SELECT user_id, CAST(reel AS BIGINT) AS reel, min(event_id) AS first_segment, max(event_id) AS last_segment, count(*) AS segments, bool_or(o) AS has_opener, bool_or(c) AS has_closer FROM r GROUP BY 1, 2""")
def session_reels(spark, sf_dir):
    """Reels of each user's events: sign-ups open one, errors close one."""
    return reel_groups(events(spark, sf_dir), "user_id", "event_id", "event_type", {"signup"}, {"error"})


@query()
def greedy_assign(spark, sf_dir):
    """Finished orders of a customer with the open ones nearest in price."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bucket"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return nearest_assignment(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "bucket")


@query()
def collision_buckets(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("value").cast("double").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return collision_groups(e, "user_id", "event_id", "x", "y", 12.0)


@query()
def marker_clusters(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", F.col("value").cast("double").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return median_clusters(e, "user_id", "event_id", "x", "y", 12.0)
