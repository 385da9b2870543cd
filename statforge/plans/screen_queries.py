"""Registered queries on screens, orders of display and historical totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.clock import seconds_of
from ..functions.nulls import ratio
from ..operators.bundles import deduplicated_in_order, subject_bundles
from ..operators.classify import classified, fitted
from ..operators.screens import aligned_subjects, away_side, density_radius, drain_decision, existing_events, filled_rows, recorded_at, without_junk
from ..sources.tables import MATCHES, PLAYERS, dealt, matches, player_matches, read
from .registry import query

PCT = "CASE WHEN ({b}) > 0 THEN CAST(round(CAST({a} AS DECIMAL(38,6)) * 100 / CAST(({b}) AS DECIMAL(38,6)), 2) AS DOUBLE) END"


def place(*order):
    """Place of each row in an order of the whole table, within brands of parts."""
    return F.row_number().over(Window.partitionBy("p_brand").orderBy(*order)).cast("long")


@query(f"""WITH s AS (SELECT l_suppkey AS player_id, count(*) AS gp, CAST(sum(l_quantity) AS BIGINT) AS goals, CAST(sum(CASE WHEN l_discount > 0.02 THEN l_linenumber END) AS BIGINT) AS fow, CAST(sum(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS BIGINT) AS fol FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1)
SELECT player_id, gp, goals, {PCT.format(a='fow', b='fow + coalesce(fol, 0)')} AS faceoff_pct FROM s""")
def historical_skaters(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R' AND l_linestatus = 'O'")
    s = x.groupBy(F.col("l_suppkey").alias("player_id")).agg(
        F.count("*").alias("gp"), F.sum("l_quantity").cast("long").alias("goals"), F.sum(F.when(F.col("l_discount") > 0.02, F.col("l_linenumber"))).alias("fow"), F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))).cast("long").alias("fol")
    )
    return s.select("player_id", "gp", "goals", ratio(F.col("fow"), F.col("fow") + F.coalesce("fol", F.lit(0))).alias("faceoff_pct"))


@query(f"""WITH {PLAYERS}, g AS (SELECT player_id, count(*) AS gp, CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(shifts) AS BIGINT) AS goals_against FROM pm WHERE is_goalie GROUP BY 1) SELECT *, {PCT.format(a='saves', b='saves + goals_against')} AS save_pct FROM g""")
def historical_goalies(spark, sf_dir):
    g = player_matches(spark, sf_dir).filter("is_goalie").groupBy("player_id").agg(F.count("*").alias("gp"), F.sum("saves").alias("saves"), F.sum("shifts").alias("goals_against"))
    return g.withColumn("save_pct", ratio(F.col("saves"), F.col("saves") + F.col("goals_against")))


def of_mode(rows, mode: str | None):
    """Base facts of a mode; without one nothing is filtered, not even null modes."""
    return rows if mode is None else rows.filter(F.col("mode") == mode)


@query(f"WITH {MATCHES} SELECT 'all' AS scope, count(*) AS n FROM matches UNION ALL SELECT 'urgent', count(*) FROM matches WHERE mode = '1-URGENT'")
def mode_scopes(spark, sf_dir):
    m = matches(spark, sf_dir)
    count = lambda name, mode: of_mode(m, mode).agg(F.lit(name).alias("scope"), F.count("*").alias("n"))
    return count("all", None).unionByName(count("urgent", "1-URGENT"))


@query("""WITH p AS (SELECT *, CASE WHEN p_size > 5 THEN p_size END AS score FROM part), n AS (SELECT p_brand, p_name, p_type, count(*) AS gp, max(p_partkey) AS k, avg(p_size) AS pct FROM part GROUP BY 1, 2, 3)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(score, -1) DESC, p_partkey) AS null_as_minus_one, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC NULLS LAST, p_name, p_type, p_partkey) AS by_codepoint,
row_number() OVER (PARTITION BY p_brand ORDER BY p_size // 10, p_name || p_type, p_partkey) AS by_priority FROM p""")
def display_orders(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("score", F.when(F.col("p_size") > 5, F.col("p_size")))
    return p.select("p_partkey", place(F.desc(F.coalesce("score", F.lit(-1))), "p_partkey").alias("null_as_minus_one"), place(F.desc_nulls_last("score"), "p_name", "p_type", "p_partkey").alias("by_codepoint"), place(F.floor(F.col("p_size") / 10), F.concat("p_name", "p_type"), "p_partkey").alias("by_priority"))


#: Orders a reader may choose for the pair matrix.
MATRIX = {"gp": [F.desc, "gp"], "pct": [F.desc_nulls_last, "pct"], "average": [F.desc_nulls_last, "average"], "name": [F.asc, "name"]}


@query("""WITH n AS (SELECT p_brand, p_name AS name, count(*) AS gp, sum(CASE WHEN p_size > 25 THEN p_size END) / CAST(count(*) AS DOUBLE) AS pct, CAST(sum(p_size) AS DOUBLE) / count(*) AS average FROM part GROUP BY 1, 2)
SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY gp DESC, name) AS gp, row_number() OVER (PARTITION BY p_brand ORDER BY pct DESC NULLS LAST, name) AS pct, row_number() OVER (PARTITION BY p_brand ORDER BY average DESC NULLS LAST, name) AS average, row_number() OVER (PARTITION BY p_brand ORDER BY name) AS by_name FROM n""")
def matrix_orders(spark, sf_dir):
    n = read(spark, sf_dir, "part").groupBy("p_brand", F.col("p_name").alias("name")).agg(F.count("*").alias("gp"), (F.sum(F.when(F.col("p_size") > 25, F.col("p_size"))) / F.count("*").cast("double")).alias("pct"), (F.sum("p_size").cast("double") / F.count("*")).alias("average"))
    ranks = {k: place(order(c), "name") for k, (order, c) in MATRIX.items()}
    return n.select("p_brand", "name", *[r.alias("by_name" if k == "name" else k) for k, r in ranks.items()])


CLOCKED = "c AS (SELECT event_id, user_id, event_id % 3 + 1 AS period, CASE WHEN value > 10 THEN lpad(CAST(event_id * 11 % 20 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id * 7 % 60 AS VARCHAR), 2, '0') END AS clock, event_id * 11 % 20 * 60 + event_id * 7 % 60 AS s, value FROM events)"


@query(f"""WITH {CLOCKED}, d AS (SELECT *, CASE WHEN value > 10 THEN s END AS left_s FROM c)
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY left_s DESC NULLS LAST, event_id) AS by_clock, row_number() OVER (PARTITION BY user_id ORDER BY period, left_s DESC NULLS LAST, event_id) AS chronological,
row_number() OVER (PARTITION BY user_id ORDER BY period DESC, left_s ASC NULLS LAST, event_id) AS newest FROM d""")
def event_orders(spark, sf_dir):
    """Clocks count down, so time order flips both period and clock."""
    n = F.col("event_id")
    clock = F.concat(F.lpad((n * 11 % 20).cast("string"), 2, "0"), F.lit(":"), F.lpad((n * 7 % 60).cast("string"), 2, "0"))
    e = read(spark, sf_dir, "events").select("event_id", "user_id", (n % 3 + 1).alias("period"), seconds_of(F.when(F.col("value") > 10, clock)).alias("left_s"))
    rank = lambda *c: F.row_number().over(Window.partitionBy("user_id").orderBy(*c, "event_id")).cast("long")
    return e.select("event_id", rank(F.desc_nulls_last("left_s")).alias("by_clock"), rank("period", F.desc_nulls_last("left_s")).alias("chronological"), rank(F.desc("period"), F.asc_nulls_last("left_s")).alias("newest"))


@query(f"""WITH {PLAYERS}, u AS (SELECT match_id, player_id, goals, 'skater' AS team FROM pm WHERE NOT is_goalie UNION ALL SELECT match_id, player_id, goals, 'goalie' FROM pm WHERE is_goalie)
SELECT match_id, player_id, team, goals FROM u QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY goals DESC, player_id) <= 3""")
def three_stars(spark, sf_dir):
    u = player_matches(spark, sf_dir).filter("is_goalie IS NOT NULL").withColumn("team", F.when(F.col("is_goalie"), "goalie").otherwise("skater"))
    k = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("goals"), "player_id"))
    return u.withColumn("k", k).filter("k <= 3").select("match_id", "player_id", "team", "goals")


@query(f"WITH {MATCHES}, t AS (SELECT opponent_id, title, count(*) AS gp FROM matches GROUP BY 1, 2) SELECT opponent_id, min(title) AS newest, arg_min(gp, title) AS gp FROM t GROUP BY 1")
def newest_title(spark, sf_dir):
    """Titles are numbered from the newest on, so the lowest number is the newest."""
    t = matches(spark, sf_dir).groupBy("opponent_id", "title").agg(F.count("*").alias("gp"))
    return t.groupBy("opponent_id").agg(F.min("title").alias("newest"), F.min_by("gp", "title").alias("gp"))


@query("SELECT l_orderkey AS match_id, l_suppkey AS player_id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def lineup_authority(spark, sf_dir):
    seen = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("player_id"))
    named = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    return seen.union(named).distinct()


#: Actors are edits of the event's own kind: a bracket, capitals, a letter more, an initial, a short form.
READINGS = """r AS (SELECT event_id AS id, user_id, event_type, CAST(event_id % 2 AS VARCHAR) || ':00' AS clock, CASE WHEN value > 60 OR value < 15 THEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 END AS actor_id,
  CASE CAST(json_extract(props, '$.k') AS BIGINT) % 6 WHEN 0 THEN event_type || ' [' WHEN 1 THEN upper(event_type) WHEN 2 THEN event_type || 's' WHEN 3 THEN 'q. ' || event_type WHEN 4 THEN 'Q.' || upper(event_type) ELSE left(event_type, 2) END AS actor, value >= 70 AS placed, value FROM events)"""
SNAP = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def readings(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    kind, v = F.col("event_type"), F.col("value")
    forms = F.array(F.concat(kind, F.lit(" [")), F.upper(kind), F.concat(kind, F.lit("s")), F.concat(F.lit("q. "), kind), F.concat(F.lit("Q."), F.upper(kind)), F.left(kind, F.lit(2)))
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", "event_type", F.concat((F.col("event_id") % 2).cast("string"), F.lit(":00")).alias("clock"), F.when((v > 60) | (v < 15), k % 3).alias("actor_id"), F.get(forms, (k % 6).cast("int")).alias("actor"), (v >= 70).alias("placed"), "value")


@query(f"""WITH {READINGS}, a AS (SELECT *, {SNAP.format(c='actor')} AS tag FROM r WHERE value < 40), b AS (SELECT *, {SNAP.format(c='actor')} AS tag FROM r WHERE value >= 40),
m AS (SELECT a.id, b.id AS existing, CASE WHEN b.placed AND length(a.tag) >= 4 AND left(a.tag, 4) = left(b.tag, 4) THEN 0 WHEN a.actor_id = b.actor_id THEN 1 WHEN levenshtein(a.tag, b.tag) <= 1 THEN 2 END AS s
      FROM a JOIN b USING (user_id, event_type, clock))
SELECT id, existing, ['placed_prefix', 'actor_id', 'actor_name'][s + 1] AS strategy FROM m WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, existing) = 1""")
def existing_readings(spark, sf_dir):
    r = readings(spark, sf_dir)
    return existing_events(r.filter("value < 40"), r.filter("value >= 40"), ["user_id", "event_type", "clock"])


@query(f"""WITH {READINGS}, t AS (SELECT *, {SNAP.format(c='actor')} AS tag FROM r)
SELECT id, placed FROM t WHERE placed OR length(tag) < 4 OR NOT EXISTS (SELECT 1 FROM t x WHERE x.placed AND length(x.tag) >= 4 AND x.user_id = t.user_id AND x.event_type = t.event_type AND x.clock = t.clock AND left(x.tag, 4) = left(t.tag, 4))""")
def junk_cleanup(spark, sf_dir):
    return without_junk(readings(spark, sf_dir), ["user_id", "event_type", "clock"]).select("id", "placed")


@query("""WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS t FROM orders),
y AS (SELECT y FROM range(1990, 2007) r(y)),
d AS (SELECT y, make_date(y, 4, 1) + CAST((7 - isodow(make_date(y, 4, 1))) % 7 AS INTEGER) AS first, make_date(y, 10, 31) - CAST(isodow(make_date(y, 10, 31)) % 7 AS INTEGER) AS last FROM y)
SELECT o_orderkey, CAST(epoch(t) AS BIGINT) + CASE WHEN t >= first + INTERVAL 2 HOUR AND t < last + INTERVAL 1 HOUR THEN 4 ELSE 5 END * 3600 AS recorded_at FROM f JOIN d ON y = year(t)
WHERE NOT (t >= first + INTERVAL 2 HOUR AND t < first + INTERVAL 3 HOUR) AND NOT (t >= last + INTERVAL 1 HOUR AND t < last + INTERVAL 2 HOUR)""")
def recording_times(spark, sf_dir):
    """File names hold the operator's local time, in a zone with daylight saving; the hours that
    a change of clocks skips or repeats are left out. In the years of the table summer time ran
    from the first Sunday of April to the last of October."""
    t = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    name = F.concat(F.lit("clip "), F.date_format(t, "yyyy-MM-dd HH-mm-ss"), F.lit(".mp4"))
    rows = recorded_at(read(spark, sf_dir, "orders").select("o_orderkey", name.alias("file")), "file", "America/New_York")
    return rows.filter(~F.col("in_change")).select("o_orderkey", "recorded_at")


@query("SELECT event_id, CAST(floor((value - 50) * 2 / 4 + 0.5) AS BIGINT) AS rounded, CASE WHEN n <= 300 THEN 15.0 WHEN n <= 1500 THEN 15 - 5 * (n - 300) / 1200 WHEN n <= 5000 THEN 10 - 2 * (n - 1500) / 3500 ELSE greatest(6.0, 8 - (n - 5000) / 10000) END AS radius FROM (SELECT event_id, value, CAST(event_id AS DOUBLE) AS n FROM events)")
def pixel_radius(spark, sf_dir):
    """Halves round towards plus infinity."""
    return read(spark, sf_dir, "events").select("event_id", F.floor((F.col("value") - 50) * 2 / 4 + 0.5).alias("rounded"), density_radius(F.col("event_id")).alias("radius"))


TEAMS = """t AS (SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS own, c_nationkey % 3 AS k, c_acctbal AS bal, CASE WHEN c_acctbal > 6000 THEN c_custkey % 2 = 0 END AS was_home FROM customer)"""


@query(f"""WITH {TEAMS}, f AS (SELECT *, own AND k = 0 AS ma, own AND bal < 1000 AS mh, k = 1 AS la, bal >= 1000 AND bal < 3000 AS lh FROM t)
SELECT c_custkey, CASE WHEN was_home THEN 'against' WHEN NOT was_home THEN 'for' WHEN ma AND NOT mh THEN 'for' WHEN mh AND NOT ma THEN 'against' WHEN la AND NOT lh THEN 'against' WHEN lh AND NOT la THEN 'for' END AS away_side FROM f""")
def team_sides(spark, sf_dir):
    """Teams are shown by segment or by nation; two segments are ours, the nation is theirs."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b, k, segment, nation = F.col("c_acctbal"), F.col("c_nationkey") % 3, F.col("c_mktsegment"), F.col("n_name")
    away = F.when(k == 0, F.concat(segment, F.lit(" (A)"))).when(k == 1, F.concat(nation, F.lit("(A)"))).otherwise("x")
    home = F.when(b < 1000, segment).when(b < 3000, F.concat(nation, F.lit(" h"))).otherwise("x")
    return c.select("c_custkey", away_side(F.when(b > 6000, F.col("c_custkey") % 2 == 0), away, home, nation, ["building", "machinery"]).alias("away_side"))


@query("""WITH g AS (SELECT o_orderkey, o_totalprice <= 300000 AS passed FROM orders),
b AS (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT c, '' ORDER BY c) AS s FROM (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'G' ELSE 'F' END AS c FROM lineitem WHERE l_returnflag = 'R') WHERE c IN ('A', 'B', 'D', 'G') GROUP BY 1)
SELECT o_orderkey, passed AND n IS NULL AS drain, CASE WHEN NOT passed THEN 'not_passed' WHEN n > 0 THEN 'blocked' ELSE 'drained' END AS outcome, coalesce(n, 0) AS n_blocking, coalesce(s, '') AS blocking FROM g LEFT JOIN b ON l_orderkey = o_orderkey""")
def drain_decisions(spark, sf_dir):
    n = F.col("l_linenumber")
    flags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("warn").alias("severity"), F.when(n == 1, "A").when(n == 2, "C").when(n == 3, "G").otherwise("F").alias("class_id"))
    gates = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "HOLD").otherwise("PASS").alias("decision"))
    return drain_decision(gates, flags, "o_orderkey")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS match_id, l_linenumber % 6 AS "row", CAST(100 + 80 * (l_linenumber % 6) + l_orderkey % 5 AS DOUBLE) AS y FROM lineitem WHERE l_discount > 0.03),
g AS (SELECT match_id, y - lag(y) OVER (PARTITION BY match_id ORDER BY y) AS gap FROM s), m AS (SELECT match_id, list_sort(list(gap))[count(gap) // 2 + 1] AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1),
b AS (SELECT match_id, min("row") AS r0, arg_min(y, "row") AS y0 FROM s GROUP BY 1), e AS (SELECT b.*, coalesce(m.gap, 88) AS gap, CAST(i.i AS INTEGER) AS "row" FROM b LEFT JOIN m USING (match_id), (SELECT unnest(range(0, 6)) AS i) i)
SELECT e.match_id, e."row", coalesce(s.y, y0 + (e."row" - r0) * gap) AS y, s.y IS NULL AS filled FROM e LEFT JOIN s ON s.match_id = e.match_id AND s."row" = e."row" WHERE coalesce(s.y, y0 + (e."row" - r0) * gap) BETWEEN 60.001 AND 539.999""")
def anchor_rows(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").filter("l_discount > 0.03")
    row = (F.col("l_linenumber") % 6).cast("int")
    seen = x.select(F.col("l_orderkey").alias("match_id"), row.alias("row"), (100 + 80 * row + F.col("l_orderkey") % 5).cast("double").alias("y")).distinct()
    return filled_rows(seen, ["match_id"], 6, 88.0, 60.0, 540.0)


@query(f"""WITH RECURSIVE {READINGS}, o AS (SELECT id, user_id AS g, {SNAP.format(c='actor')} AS tag, CASE WHEN value > 20 THEN actor_id END AS position, CASE WHEN value > 90 THEN actor_id END AS jersey FROM r),
d AS (SELECT g, tag, position, jersey, min(id) AS id FROM o GROUP BY ALL),
e AS (SELECT a.g, a.id AS u, b.id AS v, least(6, length(a.tag), length(b.tag)) AS n, a.tag AS s, b.tag AS t, (a.position <> b.position) IS TRUE OR (a.jersey <> b.jersey) IS TRUE AS clash FROM d a JOIN d b ON a.g = b.g AND a.id <> b.id),
l AS (SELECT u, v FROM e WHERE s = t OR (n >= 3 AND (levenshtein(left(s, n), left(t, n)) < 2 OR (levenshtein(left(s, n), left(t, n)) = 2 AND NOT clash)))),
reach AS (SELECT id AS a, id AS b FROM d UNION SELECT reach.a, l.v FROM reach JOIN l ON reach.b = l.u),
c AS (SELECT a, min(b) AS bundle FROM reach GROUP BY 1)
SELECT o.id, c.bundle FROM o JOIN d ON o.g = d.g AND o.tag = d.tag AND o.position IS NOT DISTINCT FROM d.position AND o.jersey IS NOT DISTINCT FROM d.jersey JOIN c ON c.a = d.id""")
def subject_bundling(spark, sf_dir):
    """Which readings of a user's events show the same subject."""
    v = F.col("value")
    seen = readings(spark, sf_dir).select("id", "user_id", F.col("actor").alias("gamertag"), F.when(v > 20, F.col("actor_id")).alias("position"), F.when(v > 90, F.col("actor_id")).alias("jersey"))
    return subject_bundles(seen, "user_id")


@query()
def run_duplicates(spark, sf_dir):
    """Events of a run against stored ones and those inserted before them."""
    r = readings(spark, sf_dir).withColumns({"x": F.when(F.col("value") > 30, F.col("value") / 20), "y": F.lit(1.0)})
    return deduplicated_in_order(r.filter("value >= 80"), r.filter("value < 80"), ["user_id", "event_type", "clock"], "id")


@query()
def subject_alignment(spark, sf_dir):
    """True subjects of a match: its players; predicted slots: their names with a letter lost."""
    x = dealt(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("id")), "match_id").distinct()
    truth = x.withColumn("gamertag", F.concat(F.lit("tag"), F.col("id").cast("string")))
    slots = x.select("match_id", (F.col("id") + 1).alias("id"), F.concat(F.lit("tg"), F.col("id").cast("string")).alias("gamertag"))
    return aligned_subjects(truth, slots, "match_id")


@query(f"""WITH {PLAYERS}, {MATCHES}, t AS (SELECT player_id, count(*) AS gp, CAST(sum(goals) AS BIGINT) AS goals FROM pm GROUP BY 1), n AS (SELECT player_id, pm.match_id, goals, row_number() OVER (PARTITION BY player_id ORDER BY played_at DESC, pm.match_id DESC) AS k FROM pm JOIN matches USING (match_id)),
l AS (SELECT player_id, CAST(sum(goals) AS BIGINT) AS last_five, arg_max(match_id, (goals, -k)) AS best_recent FROM n WHERE k <= 5 GROUP BY 1)
SELECT t.player_id, gp, t.goals, rank() OVER (ORDER BY t.goals DESC) AS place, last_five, best_recent FROM t LEFT JOIN l USING (player_id)""")
def profile_overview(spark, sf_dir):
    """Totals, place among all players, and form; the place counts one row a player."""
    p = player_matches(spark, sf_dir)
    t = p.groupBy("player_id").agg(F.count("*").alias("gp"), F.sum("goals").alias("goals"))
    ahead = t.groupBy("goals").agg(F.count("*").alias("n"))
    place_of = ahead.withColumn("place", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("goals")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).select("goals", "place")
    newest = Window.partitionBy("player_id").orderBy(F.desc("played_at"), F.desc("match_id"))
    last = p.join(matches(spark, sf_dir).select("match_id", "played_at"), "match_id").withColumn("k", F.row_number().over(newest)).filter("k <= 5")
    form = last.groupBy("player_id").agg(F.sum("goals").alias("last_five"), F.max_by("match_id", F.struct("goals", -F.col("k"))).alias("best_recent"))
    return t.join(place_of, "goals").join(form, "player_id", "left").select("player_id", "gp", "goals", "place", "last_five", "best_recent")


@query()
def screen_scores(spark, sf_dir):
    """Order status from price, month and customer: a model of all orders, scored on them."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1000).alias("price"), F.month("o_orderdate").cast("double").alias("month"), F.col("o_custkey").cast("double").alias("who"))
    return classified(fitted(o, "o_orderstatus", ["price", "month", "who"]), o, "o_orderkey", "o_orderstatus")
