"""Registered player scores, possession, completeness of line-ups and shot zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.depth import depth_charts
from ..operators.ratings import ACTIVITY, WEIGHTS, completeness, possession, rated, winner, zone_totals
from ..sources.tables import read
from .registry import query

COUNTERS = ["goals", "assists", "plus_minus", "shots", "hits", "interceptions", "blocked_shots", "takeaways", "giveaways", "faceoff_wins", "faceoff_losses", "penalties_drawn", "pim", "saves", "goals_against", "shots_against", "desperation_saves", "breakaway_saves", "penalty_saves", "poke_checks"]
#: One row a line: counters are remainders of its keys, null, negative and 0 among them.
PLAYED = f"""c AS (SELECT l_orderkey AS match_id, l_linenumber, l_suppkey, l_partkey, l_returnflag = 'R' AS is_goalie, CASE l_linestatus WHEN 'F' THEN 'for' ELSE 'against' END AS side, CASE o_orderstatus WHEN 'P' THEN 'DNF' ELSE 'X' END AS result, o_custkey % 5 AS ours, o_orderkey % 4 AS theirs,
  {', '.join(f"CASE WHEN (l_partkey + {i}) % 11 > 0 AND l_discount > 0.02 THEN (l_suppkey + {i} * l_linenumber) % {3 + i % 4}{' - 1' if n == 'plus_minus' else ''} ELSE {'NULL' if i > 12 else 0} END AS {n}" for i, n in enumerate(COUNTERS))} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def played(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    one = lambda i, n: F.when(((F.col("l_partkey") + i) % 11 > 0) & (F.col("l_discount") > 0.02), (F.col("l_suppkey") + i * F.col("l_linenumber")) % (3 + i % 4) - int(n == "plus_minus")).otherwise(None if i > 12 else 0)
    result = F.when(F.col("o_orderstatus") == "P", "DNF").otherwise("X")
    side = F.when(F.col("l_linestatus") == "F", "for").otherwise("against")
    return x.select(F.col("l_orderkey").alias("match_id"), "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").alias("is_goalie"), side.alias("side"), winner(result, F.col("o_custkey") % 5, F.col("o_orderkey") % 4).alias("winner"), *[one(i, n).alias(n) for i, n in enumerate(COUNTERS)])


NET = {"faceoff_net": "coalesce(faceoff_wins, 0) - coalesce(faceoff_losses, 0)", "save_share": "CASE WHEN shots_against > 0 THEN coalesce(saves, 0) / CAST(shots_against AS DOUBLE) ELSE 0 END"}
POINTS = {role: " + ".join(f"({w}) * CAST({NET.get(n, f'coalesce({n}, 0)')} AS DOUBLE)" for n, w in weights.items()) for role, weights in WEIGHTS.items()}
SEEN = {role: " OR ".join(f"coalesce({n}, 0) {'<>' if n == 'plus_minus' else '>'} 0" for n in names) for role, names in ACTIVITY.items()}
WON = "(result <> 'DNF' AND ((side = 'for' AND ours > theirs) OR (side = 'against' AND theirs > ours)))"


@query(f"""WITH {PLAYED} SELECT match_id, l_linenumber, l_suppkey, l_partkey, is_goalie, round(CASE WHEN is_goalie THEN {POINTS['goalie']} ELSE {POINTS['skater']} END + CASE WHEN {WON} THEN 1 ELSE 0 END, 6) AS score,
  CASE WHEN is_goalie THEN {SEEN['goalie']} ELSE {SEEN['skater']} END AS took_part, CASE WHEN is_goalie THEN 7 ELSE 12 END + CASE WHEN {WON} THEN 1 ELSE 0 END AS parts, round(CASE WHEN faceoff_wins + faceoff_losses > 0 THEN faceoff_wins * 100.0 / (faceoff_wins + faceoff_losses) END, 6) AS faceoff_pct FROM c""")
def player_scores(spark, sf_dir):
    rows = rated(played(spark, sf_dir))
    return rows.select("match_id", "l_linenumber", "l_suppkey", "l_partkey", "is_goalie", F.round("score", 6).alias("score"), "took_part", F.size("parts").alias("parts"), F.round("faceoff_pct", 6).alias("faceoff_pct"))


@query(f"""WITH {PLAYED} SELECT is_goalie, part, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS value, CAST(round(sum(points), 4) AS DOUBLE) AS points FROM (
{' UNION ALL '.join(f"SELECT is_goalie, '{n}' AS part, CAST({NET.get(n, f'coalesce({n}, 0)')} AS DOUBLE) AS value, ({w}) * CAST({NET.get(n, f'coalesce({n}, 0)')} AS DOUBLE) AS points FROM c WHERE {'' if role == 'goalie' else 'NOT '}is_goalie" for role, weights in WEIGHTS.items() for n, w in weights.items())}
UNION ALL SELECT is_goalie, 'win_bonus', 1, 1 FROM c WHERE {WON}) GROUP BY 1, 2""")
def score_breakdown(spark, sf_dir):
    """What each part gave, over all players of a role."""
    parts = rated(played(spark, sf_dir)).select("is_goalie", F.inline("parts"))
    exact = lambda c: F.round(F.sum(F.col(c).cast("decimal(28,10)")).cast("double"), 4).alias(c)
    return parts.groupBy("is_goalie", "part").agg(F.count("*").alias("n"), exact("value"), exact("points"))


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderkey % 9 AS sf, o_custkey % 7 AS sa, CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 7 = 0 THEN 0 ELSE o_custkey % 4 END AS hf, CASE WHEN o_orderkey % 9 = 0 AND o_custkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 END AS ha,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 300 END AS af, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey % 300 END AS aa, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 101 AS DOUBLE) END AS fo, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 12 END AS rf, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey % 6 END AS ra FROM orders),
s AS (SELECT k, coalesce(rf, sf) AS sf, coalesce(ra, sa) AS sa, hf, ha, CASE WHEN af + aa > 0 THEN CAST(af AS DOUBLE) / (af + aa) END AS atk, fo / 100 AS fo FROM m),
p AS (SELECT k, sf + sa = 0 AND hf + ha = 0 AS nothing, CASE WHEN sf + sa > 0 THEN CAST(sf AS DOUBLE) / (sf + sa) ELSE 0.5 END AS s, CASE WHEN hf + ha > 0 THEN CAST(hf AS DOUBLE) / (hf + ha) ELSE 0.5 END AS h, atk, fo FROM s),
r AS (SELECT k, atk, fo, CASE WHEN NOT nothing THEN greatest(0, least(100, 100 * CASE WHEN atk IS NOT NULL AND fo IS NOT NULL THEN CAST(0.4 AS DOUBLE) * s + CAST(0.3 AS DOUBLE) * atk + CAST(0.2 AS DOUBLE) * fo + CAST(0.1 AS DOUBLE) * h WHEN atk IS NOT NULL THEN CAST(0.5 AS DOUBLE) * s + CAST(0.35 AS DOUBLE) * atk + CAST(0.15 AS DOUBLE) * h
  WHEN fo IS NOT NULL THEN CAST(0.55 AS DOUBLE) * s + CAST(0.3 AS DOUBLE) * fo + CAST(0.15 AS DOUBLE) * h ELSE CAST(0.7 AS DOUBLE) * s + CAST(0.3 AS DOUBLE) * h END)) END AS raw FROM p)
SELECT k AS match_id, concat_ws('+', CASE WHEN atk IS NOT NULL THEN 'attack' END, CASE WHEN fo IS NOT NULL THEN 'faceoffs' END) AS known, floor(raw * 10 + 0.5) / 10 AS edge, CAST(floor(raw + 0.5) AS BIGINT) AS edge_for, 100 - CAST(floor(raw + 0.5) AS BIGINT) AS edge_against FROM r""")
def possession_edge(spark, sf_dir):
    o, n, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    idle = (n % 9 == 0) & (c % 7 == 0)
    m = o.select(
        n.alias("match_id"), (n % 9).alias("shots_for"), (c % 7).alias("shots_against"), F.when(idle, 0).otherwise(c % 4).alias("hits_for"), F.when(idle, 0).otherwise(n % 3).alias("hits_against"),
        F.when(F.col("o_orderstatus") != "P", c % 300).alias("attack_for"), F.when(F.col("o_orderpriority") != "5-LOW", n % 300).alias("attack_against"), F.when(n % 2 == 0, c % 101).alias("faceoff_pct"),
        F.when(n % 5 == 0, c % 12).alias("read_shots_for"), F.when(n % 10 == 0, c % 6).alias("read_shots_against"),
    )
    return possession(m).select("match_id", "known", "edge", "edge_for", "edge_against")


@query("""WITH d AS (SELECT source AS team, lang, doc_id, n_chars FROM documents),
t AS (SELECT team, CASE WHEN doc_id % 7 > 1 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN lang <> 'de' THEN 1 ELSE 0 END AS ident, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS build, CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS bio, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS attr,
  CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS traits, CASE WHEN lang = 'en' THEN 1 + CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END ELSE 0 END AS named, CASE WHEN lang = 'en' AND doc_id % 6 = 0 THEN 1 ELSE 0 END AS tiers FROM d),
g AS (SELECT team, sum(ident) / CAST(4 * count(*) AS DOUBLE) AS identity, sum(build) / CAST(count(*) AS DOUBLE) AS build, sum(bio) / CAST(2 * count(*) AS DOUBLE) AS bio, sum(attr) / CAST(count(*) AS DOUBLE) AS attribute,
  CASE WHEN sum(traits) > 0 THEN sum(named) / CAST(sum(traits) AS DOUBLE) END AS trait, CASE WHEN sum(traits) > 0 THEN sum(tiers) / CAST(sum(traits) AS DOUBLE) END AS tier FROM t GROUP BY 1)
SELECT team, round(identity, 9) AS identity, round(build, 9) AS build, round(bio, 9) AS bio, round(attribute, 9) AS attribute, round(trait, 9) AS trait, round(tier, 9) AS tier, round((identity + build + bio + attribute + coalesce(trait + tier, 0)) / CASE WHEN trait IS NULL THEN 4 ELSE 6 END, 9) AS overall FROM g""")
def completeness_buckets(spark, sf_dir):
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    trait = lambda name, tier: F.struct(name.alias("name"), tier.alias("tier"))
    rows = d.select(
        F.col("source").alias("team"), F.array(F.when(i % 7 > 1, "12"), F.when(i % 2 == 0, "J. Doe"), F.lit("tag"), F.when(F.col("lang") != "de", "pc")).alias("identity"), F.when(F.col("n_chars") > 500, "sniper").alias("build"), F.array(F.when(i % 5 > 0, "6'1\""), F.lit(None).cast("string")).alias("bio"),
        F.when(i % 3 > 0, 4).otherwise(0).alias("attributes"), F.when(F.col("lang") == "en", F.array(trait(F.lit("one"), F.lit(None).cast("string")), trait(F.when(i % 4 > 0, "two"), F.when(i % 6 == 0, "Elite")))).alias("traits"),
    )
    g = completeness(rows, ["team"])
    return g.select("team", *[F.round(c, 9).alias(c) for c in g.columns if c != "team"])


ZONES = ", ".join(f"CAST(sum(coalesce(CAST(floor(abs(embedding[{i + 1}]) * 100) AS BIGINT), 0)) AS BIGINT)" for i in range(16))


@query(f"""WITH e AS (SELECT *, CAST(embedding[33] AS DOUBLE) < 0 AS goalie, abs(CAST(embedding[64] AS DOUBLE)) AS games FROM embeddings), c AS (SELECT label, CASE WHEN goalie THEN 'goalie' ELSE 'skater' END AS role, embedding FROM e WHERE CASE WHEN goalie THEN games >= 0.01 ELSE games >= 0.05 END),
g AS (SELECT label, role, count(*) AS n, [{ZONES}] AS ice, [{', '.join(ZONES.split(', CAST(sum')[0] if i == 0 else 'CAST(sum' + ZONES.split(', CAST(sum')[i] for i in range(5))}] AS net FROM c GROUP BY 1, 2)
SELECT label, role, n, array_to_string(ice, ',') AS ice, array_to_string(net, ',') AS net, round(ice[1] / CAST(n AS DOUBLE), 6) AS first_mean, round(net[5] / CAST(n AS DOUBLE), 6) AS last_mean FROM g""")
def shot_zones(spark, sf_dir):
    """Sums and means over skaters and goalies who played enough, goalies by a lower bar;
    sixteen zones of the ice and five of the net."""
    e = read(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    goalie, games = at(32) < 0, F.abs(at(63))
    whole = F.transform("embedding", lambda x: F.floor(F.abs(x) * 100))
    rows = e.filter(F.when(goalie, games >= 0.01).otherwise(games >= 0.05)).select("label", F.when(goalie, "goalie").otherwise("skater").alias("role"), whole.alias("ice"), F.slice(whole, 1, 5).alias("net"))
    g = zone_totals(rows, ["label", "role"], {"ice": 16, "net": 5})
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return g.select("label", "role", "n", text("ice_sum").alias("ice"), text("net_sum").alias("net"), F.round(F.get("ice_mean", F.lit(0)), 6).alias("first_mean"), F.round(F.get("net_mean", F.lit(4)), 6).alias("last_mean"))


TEAMS = """u AS (SELECT o_custkey AS player, count_if(o_orderpriority = '1-URGENT') AS lw, count_if(o_orderpriority = '2-HIGH') AS ce, count_if(o_orderpriority = '3-MEDIUM') AS rw, count_if(o_orderpriority LIKE '4%') AS de, count_if(o_orderpriority LIKE '5%') AS go FROM orders GROUP BY 1),
m AS (SELECT c_mktsegment || ' ' || c_nationkey AS team, player, lw, ce, rw, de, go, lw + ce + rw + de AS gp, CASE CAST(floor(abs(c_acctbal)) AS BIGINT) % 5 WHEN 0 THEN 'left_wing' WHEN 1 THEN 'center' WHEN 2 THEN 'right_wing' WHEN 3 THEN 'goalie' END AS fav FROM u JOIN customer ON player = c_custkey),
r AS (SELECT *, CASE WHEN coalesce(fav = 'goalie', false) OR go > gp THEN 'goalie' WHEN de > lw + ce + rw THEN 'defense' WHEN de > 0 THEN 'hybrid' ELSE 'forward' END AS role FROM m),
l AS (SELECT team, player, gp, role, fav, 0 AS lane, 'left_wing' AS name, lw AS n FROM r UNION ALL SELECT team, player, gp, role, fav, 1, 'center', ce FROM r UNION ALL SELECT team, player, gp, role, fav, 2, 'right_wing', rw FROM r),
f AS (SELECT *, 100 * n + CASE row_number() OVER (PARTITION BY team, player ORDER BY n DESC, lane) WHEN 1 THEN 30 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN name = 'center' THEN 5 ELSE 0 END + CASE WHEN fav = name THEN 600 ELSE 0 END AS fit FROM l),
p AS (SELECT team, player, gp, lane, name, role IN ('defense', 'goalie') AS misfit, 1 AS turn, fit - CASE role WHEN 'hybrid' THEN 200 WHEN 'defense' THEN 500 WHEN 'goalie' THEN 1000 ELSE 0 END AS score FROM f UNION ALL SELECT team, player, gp, lane, name, role IN ('defense', 'goalie'), 2, fit - CASE role WHEN 'defense' THEN 1000 WHEN 'goalie' THEN 2000 ELSE 0 END FROM f),
s AS (SELECT team, i, CASE WHEN i < n THEN 1 ELSE 2 END AS turn, row_number() OVER (PARTITION BY team ORDER BY CASE WHEN i < n THEN i ELSE 12 + i % 3 * 4 + i // 3 END) AS step FROM (SELECT team, count(*) AS n FROM r GROUP BY 1), range(12) x(i))"""


@query(f"""WITH RECURSIVE {TEAMS}, w AS (SELECT DISTINCT team, CAST(0 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS once, CAST([] AS BIGINT[]) AS twice, CAST(NULL AS BIGINT) AS player FROM r
UNION ALL SELECT team, step, i, CASE WHEN turn = 1 THEN list_append(once, pick) ELSE once END, CASE WHEN turn = 2 THEN list_append(twice, pick) ELSE twice END, pick FROM (
  SELECT w.team, s.step, s.i, s.turn, w.once, w.twice, list(p.player ORDER BY p.score DESC, p.gp DESC, p.player)[1] AS pick FROM w JOIN s ON s.team = w.team AND s.step = w.step + 1 JOIN p ON p.team = w.team AND p.turn = s.turn AND p.lane = s.i % 3
  WHERE NOT list_contains(CASE WHEN s.turn = 1 THEN w.once ELSE w.twice END, p.player) GROUP BY ALL)),
x AS (SELECT team, i // 3 + 1 AS line, CASE i % 3 WHEN 0 THEN 'left_wing' WHEN 1 THEN 'center' ELSE 'right_wing' END AS lane, player, row_number() OVER (PARTITION BY team, player ORDER BY i) > 1 OR role IN ('defense', 'goalie') AS is_depth FROM w JOIN r USING (team, player) WHERE i >= 0),
d AS (SELECT team, player, role, row_number() OVER (PARTITION BY team ORDER BY de > 0 DESC, de * 100 - CASE WHEN role = 'goalie' THEN 2000 ELSE 0 END DESC, player) - 1 AS k FROM r), g AS (SELECT team, player, role, row_number() OVER (PARTITION BY team ORDER BY go DESC, player) AS k FROM r WHERE go > 0)
SELECT * FROM x UNION ALL SELECT team, k // 2 + 1, CASE k % 2 WHEN 0 THEN 'left_defense' ELSE 'right_defense' END, player, role <> 'defense' FROM d WHERE k < 6 UNION ALL SELECT team, k, 'goalie', player, role <> 'goalie' FROM g WHERE k <= 5""")
def team_depth(spark, sf_dir):
    """Customers of a nation and segment as a team, orders as games, their priority as position."""
    kind = F.substring("o_orderpriority", 1, 1)
    n = lambda k: F.count_if(kind == k).cast("long")
    use = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("player")).agg(n("1").alias("left_wing"), n("2").alias("center"), n("3").alias("right_wing"), n("4").alias("defense"), n("5").alias("goalie_gp"))
    c = read(spark, sf_dir, "customer")
    favorite = F.get(F.array(*[F.lit(x) for x in ("left_wing", "center", "right_wing", "goalie")]), (F.floor(F.abs("c_acctbal")) % 5).cast("int"))
    team = F.concat_ws(" ", "c_mktsegment", "c_nationkey")
    members = use.join(c.select(F.col("c_custkey").alias("player"), team.alias("team"), favorite.alias("favorite")), "player")
    return depth_charts(members.withColumn("skater_gp", F.expr("left_wing + center + right_wing + defense")))
