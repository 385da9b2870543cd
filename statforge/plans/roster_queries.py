"""Registered lineup, identity, scoring and read-model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nulls import count_where
from ..operators.joins import bound_alone, far_from, lineup_gate
from ..operators.lineups import anchored, captains, closed_vocabulary, depth_chart, next_older, source_counts
from ..operators.walking import rejection_climb
from ..sources.tables import EVENTS, MATCHES, PLAYERS, events, matches, player_matches, read
from .registry import query


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 100)")
def point_lookup(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 7, 32, 100)).select("o_orderkey", "o_totalprice")


@query(r"""SELECT p_partkey, p_type LIKE 'a_%' AS wild, p_brand LIKE 'Brand\_%' ESCAPE '\' AS literal, length(trim(p_name)) > 1 AND lower(trim(p_name)) NOT IN ('cold widget', 'unknown', 'n/a') AS real_name FROM part""")
def like_patterns(spark, sf_dir):
    name = F.trim("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_type").like("a_%").alias("wild"), F.col("p_brand").like("Brand\\_%").alias("literal"),
        ((F.length(name) > 1) & ~F.lower(name).isin("cold widget", "unknown", "n/a")).alias("real_name"),
    )


RUNS = f"{EVENTS}, x AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN user_id END AS run_id FROM ev), active AS (SELECT c_custkey AS run_id FROM customer WHERE c_acctbal > 3000)"


def runs(spark, sf_dir):
    x = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("run_id"))
    return x, read(spark, sf_dir, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").alias("run_id"))


@query(f"WITH {RUNS} SELECT event_id, run_id FROM x WHERE run_id IS NULL OR run_id IN (SELECT run_id FROM active)")
def live_runs(spark, sf_dir):
    """Facts without a run, or of an active one."""
    x, active = runs(spark, sf_dir)
    return x.filter("run_id IS NULL").unionByName(x.join(active, "run_id", "left_semi").select("event_id", "run_id"))


@query(f"WITH {RUNS} SELECT 'live' AS scope, count(*) AS n FROM x WHERE run_id IS NULL OR run_id IN (SELECT run_id FROM active) UNION ALL SELECT 'unlinked', count(*) FROM x WHERE run_id IS NULL UNION ALL SELECT 'run 7', count(*) FROM x WHERE run_id = 7")
def run_scopes(spark, sf_dir):
    x, _ = runs(spark, sf_dir)
    scopes = [("live", live_runs(spark, sf_dir)), ("unlinked", x.filter("run_id IS NULL")), ("run 7", x.filter("run_id = 7"))]
    return reduce(lambda a, b: a.unionByName(b), [d.agg(F.count("*").alias("n")).select(F.lit(s).alias("scope"), "n") for s, d in scopes])


@query("SELECT event_id, coalesce(v IN ('true', '\"true\"'), false) AS flag FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN '\"true\"' END AS v FROM events)")
def json_boolean(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, '"true"')
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(v.isin("true", '"true"'), F.lit(False)).alias("flag"))


@query(f"WITH {PLAYERS} SELECT match_id, player_id FROM pm WHERE CASE WHEN is_goalie THEN coalesce(saves, 0) <> 0 ELSE goals > 20 OR shifts > 1 END")
def active_players(spark, sf_dir):
    busy = F.when(F.col("is_goalie"), F.coalesce("saves", F.lit(0)) != 0).otherwise((F.col("goals") > 20) | (F.col("shifts") > 1))
    return player_matches(spark, sf_dir).filter(busy).select("match_id", "player_id")


@query(f"WITH {MATCHES}, {PLAYERS} SELECT match_id, bool_or(result = 'OTL' OR toi > 60000 OR shifts >= 3) AS overtime FROM pm JOIN matches USING (match_id) GROUP BY 1")
def went_to_overtime(spark, sf_dir):
    rows = player_matches(spark, sf_dir).join(matches(spark, sf_dir), "match_id")
    return rows.groupBy("match_id").agg(F.bool_or((F.col("result") == "OTL") | (F.col("toi") > 60000) | (F.col("shifts") >= 3)).alias("overtime"))


@query("SELECT mode, CASE mode WHEN '1-URGENT' THEN '6s' WHEN '2-HIGH' THEN '6s' WHEN '3-MEDIUM' THEN '3s' END AS playlist, gp FROM (SELECT o_orderpriority AS mode, count(*) AS gp FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1) WHERE gp > 0")
def playlist_modes(spark, sf_dir):
    playlists = {"1-URGENT": "6s", "2-HIGH": "6s", "3-MEDIUM": "3s"}
    m = F.col("mode")
    g = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(*playlists)).groupBy(F.col("o_orderpriority").alias("mode")).agg(F.count("*").alias("gp"))
    return g.filter("gp > 0").select("mode", F.when(m == "3-MEDIUM", "3s").otherwise("6s").alias("playlist"), "gp")


LINEUP = "lineup AS (SELECT o_orderkey AS match_id, o_custkey % 20 AS player_id FROM orders WHERE o_orderpriority <> '1-URGENT')"


@query(f"""WITH {PLAYERS}, {LINEUP}, a AS (SELECT match_id, player_id, player_id % 20 AS who FROM pm), n AS (SELECT match_id, count(*) AS size FROM lineup GROUP BY 1)
SELECT a.match_id, a.player_id, CASE WHEN n.size IS NULL THEN 'empty_lineup_passthrough' WHEN l.match_id IS NULL THEN 'roster_mismatch' ELSE 'ok' END AS gate
FROM a LEFT JOIN n USING (match_id) LEFT JOIN lineup l ON l.match_id = a.match_id AND l.player_id = a.who""")
def lineup_identity_gate(spark, sf_dir):
    lineup = read(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("match_id"), (F.col("o_custkey") % 20).alias("who"))
    actors = player_matches(spark, sf_dir).select("match_id", "player_id", (F.col("player_id") % 20).alias("who"))
    return lineup_gate(actors, lineup, "match_id", "who").select("match_id", "player_id", "gate")


@query("""WITH o AS (SELECT o_custkey || '/' || o_orderpriority AS bucket, o_orderkey, o_orderstatus = 'F' AS f FROM orders), l AS (SELECT bucket, max(o_orderkey) AS a FROM o WHERE f GROUP BY 1 HAVING count(*) = 1), r AS (SELECT bucket, max(o_orderkey) AS b FROM o WHERE NOT f GROUP BY 1 HAVING count(*) = 1)
SELECT bucket, a, b FROM l JOIN r USING (bucket)""")
def eliminate_one_to_one(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("bucket"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return bound_alone(o.filter("s = 'F'").select("bucket", F.col("id").alias("a")), o.filter("s <> 'F'").select("bucket", F.col("id").alias("b")), "bucket", "a", "b")


@query(f"""WITH {EVENTS}, c AS (SELECT * FROM ev WHERE event_type = 'click'), v AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND abs(v.value - c.value) <= 3)""")
def proximity_anti_join(spark, sf_dir):
    e = events(spark, sf_dir)
    return far_from(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"], "value", 3).select("event_id")


@query(f"""WITH {EVENTS}, r AS (SELECT *, lead(event_id) OVER w AS older, lead(event_type) OVER w AS older_type FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC))
SELECT event_id, older, older_type FROM r WHERE event_type = 'error'""")
def orphan_next_older(spark, sf_dir):
    return next_older(events(spark, sf_dir), ["user_id"], "event_id", ["event_type"]).filter("event_type = 'error'").select("event_id", "older", F.col("older_event_type").alias("older_type"))


@query(f"""WITH {PLAYERS}, s AS (SELECT match_id, is_goalie, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shifts) AS BIGINT) AS shifts FROM pm GROUP BY 1, 2),
m AS (SELECT match_id, max(goals) FILTER (WHERE is_goalie) AS a, max(goals) FILTER (WHERE NOT is_goalie) AS b FROM s GROUP BY 1)
SELECT match_id, a AS ours, b AS theirs, greatest(coalesce(a, 0), coalesce(b, 0)) AS larger FROM m""")
def both_side_totals(spark, sf_dir):
    g, side = F.col("goals"), F.col("is_goalie")
    m = player_matches(spark, sf_dir).groupBy("match_id").agg(F.sum(F.when(side, g)).alias("ours"), F.sum(F.when(~side, g)).alias("theirs"))
    return m.select("match_id", "ours", "theirs", F.greatest(F.coalesce("ours", F.lit(0)), F.coalesce("theirs", F.lit(0))).cast("long").alias("larger"))


@query(f"""WITH {EVENTS}, x AS (SELECT user_id, event_type, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS best FROM ev GROUP BY 1, 2) SELECT * FROM x""")
def best_confidence(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(k).alias("best"))


@query(f"""WITH {EVENTS} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, min(event_id) AS first_id, max(event_id) AS last_id, bool_or(event_type = 'error') AS any_error, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kind_list FROM ev GROUP BY 1""")
def provenance(spark, sf_dir):
    return source_counts(events(spark, sf_dir), ["user_id"], "event_type", "event_id", "error")


@query(f"""WITH {MATCHES}, t AS (SELECT opponent_id, result, mode, count(*) AS gp FROM matches GROUP BY 1, 2, 3),
l AS (SELECT opponent_id, 'WIN' AS stat, CAST(coalesce(sum(gp) FILTER (WHERE result = 'WIN'), 0) AS BIGINT) AS n FROM t GROUP BY 1 UNION ALL SELECT opponent_id, 'LOSS', CAST(coalesce(sum(gp) FILTER (WHERE result = 'LOSS'), 0) AS BIGINT) FROM t GROUP BY 1
UNION ALL SELECT opponent_id, 'OTL', CAST(coalesce(sum(gp) FILTER (WHERE result = 'OTL'), 0) AS BIGINT) FROM t GROUP BY 1) SELECT * FROM l WHERE n > 0""")
def box_score_long(spark, sf_dir):
    """Totals turned to one row a statistic; empty rows are dropped."""
    kinds = ("WIN", "LOSS", "OTL")
    g = matches(spark, sf_dir).groupBy("opponent_id").agg(*[count_where(F.col("result") == k).alias(k) for k in kinds])
    return g.unpivot("opponent_id", list(kinds), "stat", "n").filter("n > 0")


@query(f"""WITH {MATCHES}, r AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY opponent_id ORDER BY played_at DESC, match_id DESC) <= 10)
SELECT opponent_id, count(*) AS gp, CAST(sum(score) AS DOUBLE) / count(*) AS per_game, count_if(result = 'WIN' AND score < 20000) AS shutouts FROM r GROUP BY 1""")
def last_ten_reductions(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("opponent_id").orderBy(F.desc("played_at"), F.desc("match_id")))
    r = matches(spark, sf_dir).withColumn("k", k).filter("k <= 10").groupBy("opponent_id")
    return r.agg(F.count("*").alias("gp"), (F.sum("score").cast("double") / F.count("*")).alias("per_game"), count_where((F.col("result") == "WIN") & (F.col("score") < 20000)).alias("shutouts"))


@query(f"""WITH {PLAYERS}, s AS (SELECT *, is_goalie AS side FROM pm), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY goals DESC, player_id) AS k FROM s)
SELECT match_id, side, player_id, CASE WHEN goals >= 25 THEN 'voted' ELSE 'fallback' END AS via FROM r WHERE k = 1""")
def side_captains(spark, sf_dir):
    return captains(player_matches(spark, sf_dir).withColumn("side", F.col("is_goalie")), ["match_id", "side"], "goals", "player_id", 25)


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2),
r AS (SELECT e.user_id, e.event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY CASE WHEN e.event_type = 'purchase' THEN 0 ELSE 1 END, d.n DESC, e.value DESC, e.event_id DESC) AS k FROM ev e JOIN d USING (user_id, event_type))
SELECT user_id, event_id AS anchor FROM r WHERE k = 1""")
def anchor_choice(spark, sf_dir):
    return anchored(events(spark, sf_dir), ["user_id"], "event_type", "purchase", "value", "event_id")


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, event_id, value FROM ev)
SELECT event_type, user_id, hour, CASE count(*) WHEN 1 THEN 'single' ELSE 'repeated' END AS outcome, count(*) AS n, min(event_id) AS kept FROM k GROUP BY 1, 2, 3""")
def clockless_dedup(spark, sf_dir):
    k = events(spark, sf_dir).withColumn("hour", F.floor(F.col("ts").cast("long") / 3600))
    g = k.groupBy("event_type", "user_id", "hour").agg(F.count("*").alias("n"), F.min("event_id").alias("kept"))
    return g.withColumn("outcome", F.when(F.col("n") == 1, "single").otherwise("repeated"))


VOCABULARY = ["cold widget", "red bolts", "steel gear", "blue valve"]


@query(f"""WITH v AS (SELECT unnest({VOCABULARY!r}) AS word), p AS (SELECT p_partkey, lower(trim(p_name)) AS name FROM part),
c AS (SELECT p_partkey, word, levenshtein(name, word) AS d FROM p CROSS JOIN v QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, word) = 1)
SELECT p_partkey, CASE WHEN d <= 2 THEN word END AS canonical, CASE WHEN d = 0 THEN 1.0 WHEN d <= 2 THEN 0.5 ELSE 0.0 END AS confidence FROM c""")
def vocabulary_match(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"))
    return p.select("p_partkey", *closed_vocabulary(F.col("name"), VOCABULARY, 2))


@query("""SELECT event_id, CASE WHEN k <= 3 THEN k WHEN k = 4 THEN 4 END AS period, CASE WHEN k <= 3 THEN k || CASE k WHEN 1 THEN 'st' WHEN 2 THEN 'nd' ELSE 'rd' END WHEN k = 4 THEN 'OT' WHEN k > 4 THEN 'OT' || (k - 3) END AS label FROM (SELECT event_id, event_id % 6 + 1 AS k FROM events)""")
def period_labels(spark, sf_dir):
    k = F.col("event_id") % 6 + 1
    text = F.when(k <= 3, F.concat(k.cast("string"), F.element_at(F.array(F.lit("st"), F.lit("nd"), F.lit("rd")), F.least(k, F.lit(3)).cast("int")))).when(k == 4, "OT").otherwise(F.concat(F.lit("OT"), (k - 3).cast("string")))
    number = F.when(text == "OT", 4).otherwise(F.regexp_extract(text, r"^(\d)(st|nd|rd)$", 1).try_cast("long"))
    return read(spark, sf_dir, "events").select("event_id", number.cast("long").alias("period"), text.alias("label"))


@query("""WITH a AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), m AS (SELECT CAST(sum(q) AS DOUBLE) / count(*) AS mean FROM a), d AS (SELECT l_suppkey, (q - mean) / greatest(mean, 1) AS x FROM a, m)
SELECT l_suppkey, CASE WHEN x >= 0.5 THEN 2 WHEN x >= 0.15 THEN 1 WHEN x > -0.15 THEN 0 WHEN x > -0.5 THEN -1 ELSE -2 END AS bucket FROM d""")
def deviation_buckets(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    mean = a.agg((F.sum("q").cast("double") / F.count("*")).alias("mean"))
    x = (F.col("q") - F.col("mean")) / F.greatest("mean", F.lit(1.0))
    return a.crossJoin(F.broadcast(mean)).select("l_suppkey", F.when(x >= 0.5, 2).when(x >= 0.15, 1).when(x > -0.15, 0).when(x > -0.5, -1).otherwise(-2).alias("bucket"))  # one row


@query("""WITH x AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1), w AS (SELECT l_suppkey, q * 2 AS a, n * 5 AS b, r * -3 AS c FROM x)
SELECT l_suppkey, a, b, c, a + b + c AS total, CAST(abs(a) AS DOUBLE) / (abs(a) + abs(b) + abs(c)) AS share_a FROM w""")
def contribution_wheel(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity").cast("long") * 2).alias("a"), (F.count("*") * 5).alias("b"), (count_where(F.col("l_returnflag") == "R") * -3).alias("c"))
    spokes = [F.abs(c) for c in ("a", "b", "c")]
    return x.withColumns({"total": F.col("a") + F.col("b") + F.col("c"), "share_a": spokes[0].cast("double") / (spokes[0] + spokes[1] + spokes[2])})


@query("""WITH f AS (SELECT l_orderkey, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 0), 0) AS BIGINT) AS a, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 1), 0) AS BIGINT) AS b, CAST(coalesce(sum(l_quantity) FILTER (WHERE l_linenumber % 3 = 2), 0) AS BIGINT) AS c, CAST(sum(l_quantity) AS BIGINT) AS t FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS hot, a + b + c = t AS whole FROM f""")
def zone_grid(spark, sf_dir):
    """Fields folded to one array; its sum must be the total, and the hottest zone is the first maximum."""
    part = lambda i: F.coalesce(F.sum(F.when(F.col("l_linenumber") % 3 == i, F.col("l_quantity"))), F.lit(0.0)).cast("long")
    g = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array(*[part(i) for i in range(3)]).alias("grid"), F.sum("l_quantity").cast("long").alias("t"))
    return g.select("l_orderkey", (F.array_position("grid", F.array_max("grid")) - 1).cast("int").alias("hot"), (F.aggregate("grid", F.lit(0).cast("long"), lambda s, v: s + v) == F.col("t")).alias("whole"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def dynamic_keys(spark, sf_dir):
    """An object whose keys are not known beforehand, as rows."""
    pairs = F.from_json("props", "map<string,string>")
    rows = read(spark, sf_dir, "events").select("event_id", F.explode(F.map_filter(pairs, lambda k, v: k.rlike("^[a-z]$"))).alias("key", "value"))
    return rows.filter("key = 'k'").select("event_id", F.col("value").cast("long").alias("k"))


@query(f"""WITH {MATCHES}, e AS (SELECT match_id, CASE WHEN result = 'OTL' THEN 4 ELSE 3 END AS expected FROM matches), s AS (SELECT l_orderkey AS match_id, count(DISTINCT l_linenumber % 4) AS seen, count_if(l_returnflag = 'R') AS rejected FROM lineitem GROUP BY 1)
SELECT match_id, CASE WHEN rejected > 2 THEN 'rejected' WHEN seen IS NULL THEN 'n/a' WHEN seen < expected THEN 'incomplete' ELSE 'promoted' END AS verdict FROM e LEFT JOIN s USING (match_id)""")
def family_promotion(spark, sf_dir):
    e = matches(spark, sf_dir).select("match_id", F.when(F.col("result") == "OTL", 4).otherwise(3).alias("expected"))
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.countDistinct(F.col("l_linenumber") % 4).alias("seen"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"))
    verdict = F.when(F.col("rejected") > 2, "rejected").when(F.col("seen").isNull(), "n/a").when(F.col("seen") < F.col("expected"), "incomplete").otherwise("promoted")
    return e.join(s, "match_id", "left").select("match_id", verdict.alias("verdict"))


@query("""WITH r AS (SELECT DISTINCT 'm' || l_orderkey AS m, 'm' || l_orderkey || '/f' || l_linenumber % 2 AS f, 'm' || l_orderkey || '/f' || l_linenumber % 2 || '/' || l_linenumber AS id FROM lineitem),
b AS (SELECT DISTINCT 'm' || l_orderkey || '/f' || l_linenumber % 2 || '/' || l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT DISTINCT f AS id, m, NOT EXISTS (SELECT 1 FROM r x WHERE x.f = r.f AND x.id NOT IN (SELECT id FROM b)) AS rejected FROM r),
m AS (SELECT DISTINCT m AS id, NOT EXISTS (SELECT 1 FROM f x WHERE x.m = f.m AND NOT x.rejected) AS rejected FROM f)
SELECT id, f AS parent, id IN (SELECT id FROM b) AS rejected, CASE WHEN id IN (SELECT id FROM b) THEN 0 END AS round FROM r UNION ALL SELECT id, m, rejected, CASE WHEN rejected THEN 1 END FROM f UNION ALL SELECT id, NULL, rejected, CASE WHEN rejected THEN 2 END FROM m""")
def rejection_cascade(spark, sf_dir):
    """Returned lines reject their family, and families their match, where no sibling stands."""
    m = F.concat(F.lit("m"), F.col("l_orderkey").cast("string"))
    f = F.concat(m, F.lit("/f"), (F.col("l_linenumber") % 2).cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(m.alias("m"), f.alias("f"), F.concat(f, F.lit("/"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_returnflag").eqNullSafe("R").alias("rejected"))
    lines = rows.groupBy("id").agg(F.max("f").alias("parent"), F.bool_or("rejected").alias("rejected"))
    families = rows.groupBy(F.col("f").alias("id")).agg(F.max("m").alias("parent"))
    whole = rows.select(F.col("m").alias("id")).distinct().withColumn("parent", F.lit(None).cast("string"))
    return rejection_climb(lines.unionByName(families.unionByName(whole).withColumn("rejected", F.lit(False))))


@query("""WITH f AS (SELECT 'A' AS flag, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'B', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'G', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) SELECT flag, n, CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END AS score FROM f""")
def quality_layers(spark, sf_dir):
    o, x = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    found = {"A": o.filter("o_totalprice > 400000"), "B": x.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"), "G": o.filter("o_custkey IS NOT NULL").join(c, "o_custkey", "left_anti")}
    rows = reduce(lambda a, b: a.unionByName(b), [d.agg(F.count("*").alias("n")).withColumn("flag", F.lit(k)) for k, d in found.items()])
    return rows.select("flag", "n", F.when(F.col("n") == 0, 1.0).otherwise(0.0).alias("score"))


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view', 'purchase')) / CAST(3 AS DOUBLE) AS v1, count(DISTINCT event_type) FILTER (WHERE event_type IN ('signup', 'error')) / CAST(2 AS DOUBLE) AS v2 FROM ev GROUP BY 1)
SELECT user_id, v1, v2, CASE WHEN v1 >= v2 THEN 'v1' ELSE 'v2' END AS version FROM a""")
def version_detect(spark, sf_dir):
    """The version with the largest part of its own anchors seen."""
    anchors = {"v1": ["click", "view", "purchase"], "v2": ["signup", "error"]}
    part = [(F.countDistinct(F.when(F.col("event_type").isin(*a), F.col("event_type"))) / float(len(a))).alias(k) for k, a in anchors.items()]
    return events(spark, sf_dir).groupBy("user_id").agg(*part).withColumn("version", F.when(F.col("v1") >= F.col("v2"), "v1").otherwise("v2"))


@query(f"""WITH {EVENTS}, t AS (SELECT user_id, count_if(event_type = 'click') AS c, count_if(event_type = 'view') AS v, count(*) AS n FROM ev GROUP BY 1), s AS (SELECT user_id, CASE WHEN c + v > 0 THEN CAST(c AS DOUBLE) / (c + v) END AS a, CAST(v AS DOUBLE) / n AS b FROM t)
SELECT user_id, 'passes' AS part, (a - 0.5) * 2 * 100 AS points FROM s UNION ALL SELECT user_id, 'time', (b - 0.5) * 3 * 100 FROM s""")
def possession_parts(spark, sf_dir):
    kind = F.col("event_type")
    t = events(spark, sf_dir).groupBy("user_id").agg(count_where(kind == "click").alias("c"), count_where(kind == "view").alias("v"), F.count("*").alias("n"))
    a = F.when(F.col("c") + F.col("v") > 0, F.col("c").cast("double") / (F.col("c") + F.col("v")))
    s = t.select("user_id", ((a - 0.5) * 2 * 100).alias("passes"), ((F.col("v").cast("double") / F.col("n") - 0.5) * 3 * 100).alias("time"))
    return s.unpivot("user_id", ["passes", "time"], "part", "points")


@query()
def depth_chart_lines(spark, sf_dir):
    """Forward lines of each team by lane score, nobody twice until all are used."""
    p = player_matches(spark, sf_dir).withColumn("lane", F.element_at(F.array(F.lit("LW"), F.lit("C"), F.lit("RW")), (F.col("match_id") % 3 + 1).cast("int")))
    usage = p.groupBy((F.col("player_id") % 5).alias("team"), "player_id", "lane").agg(F.count("*").alias("gp"))
    return depth_chart(usage, "team", "player_id", "lane", "gp")
