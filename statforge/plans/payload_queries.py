"""Registered payload transforms. Payloads are written as JSON from the tables, so that SQL
can say from the tables alone what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.payloads import field_rows, keep_field, match_rows, member_rows, parsed_matches, player_rows
from ..operators.walking import walked_fields
from ..sources.tables import dealt, read
from .registry import query


def text(c):
    return c.cast("string")


def match_payloads(spark, sf_dir):
    """A payload for each order with lines: club 1 is ours, club 2 the opponent. Lines of
    status F are players of ours, lines of status O of theirs. Lines are dealt by order and
    gathered as numbers; players' fields are written in the row of their order."""
    x = dealt(read(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_orderkey")
    # rows of one key are one player, a goalie if all of them are
    x = x.groupBy("l_orderkey", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey", "q").agg(F.bool_and(F.col("l_returnflag") == "R").alias("goalie"))
    key = lambda r: F.concat_ws("-", *[F.coalesce(text(r[c]), F.lit("")) for c in ("l_linenumber", "l_suppkey", "l_partkey", "q")])
    player = lambda r: F.map_concat(
        F.create_map(F.lit("playername"), F.concat(F.lit("s"), text(r["l_suppkey"])), F.lit("position"), F.when(r["goalie"], "goalie").otherwise("center"), F.lit("skgoals"), text(r["q"]), F.lit("skfow"), text(r["l_linenumber"]), F.lit("skfol"), text(r["q"] % 3)),
        F.create_map(F.lit("skpassattempts"), text(r["q"]), F.lit("skpasspct"), F.lit("50.00"), F.lit("glsaves"), text(r["q"] + 1), F.lit("skhits"), F.lit(""), F.lit("toiseconds"), F.when(r["q"] > 10, text(r["q"] * 10))),
    )
    side = lambda s: F.collect_list(F.when(F.col("l_linestatus") == s, F.struct("l_linenumber", "l_suppkey", "l_partkey", "q", "goalie")))
    players = lambda c: F.map_from_entries(F.transform(c, lambda r: F.struct(key(r), player(r))))
    shots = lambda s: text(F.coalesce(F.sum(F.when(F.col("l_linestatus") == s, F.col("q"))), F.lit(0)))
    minutes = lambda s: text(F.sum(F.when(F.col("l_linestatus") == s, F.col("q") % 5)))
    g = x.groupBy("l_orderkey").agg(side("F").alias("f"), side("O").alias("o"), shots("F").alias("sf"), shots("O").alias("so"), minutes("F").alias("pf"), minutes("O").alias("po"))
    o = read(spark, sf_dir, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    n = F.col("o_orderkey")
    club = lambda score, **more: F.struct(text(score).alias("score"), *[v.alias(k) for k, v in more.items()])
    code = F.when(F.col("o_orderstatus") == "P", "6").when(F.col("o_orderstatus") == "F", "16385").otherwise(F.lit("10"))
    clubs = F.struct(
        club(n % 7, result=code, cNhlOnlineGameType=F.when(n % 3 == 0, "200").when(n % 3 == 1, "5"), teamSide=F.when(n % 2 == 0, "0").otherwise("1"), toa=text(n % 4), passa=text(n % 50), passc=F.when(n % 3 > 0, text(n % 40)), ppg=text(n % 3), ppo=F.when(n % 5 == 0, "").otherwise(text(n % 4))).alias("1"),
        club(n % 5, winnerByDnf=F.when(F.col("o_orderpriority") == "5-LOW", "1"), details=F.struct(F.concat(F.lit("club "), text(F.col("o_custkey"))).alias("name")), timeOnAttack=text(n % 6), passa=F.when(n % 7 > 0, text(n % 60)), passc=text(n % 30), ppg=F.when(n % 9 == 0, "none").otherwise(text(n % 2)), ppo=text(n % 8)).alias("2"),
    )
    aggregate = F.struct(F.struct(F.col("sf").alias("skshots"), F.col("pf").alias("skpim")).alias("1"), F.struct(F.col("so").alias("skshots"), F.col("po").alias("pim")).alias("2"))
    payload = F.to_json(F.struct(F.concat(F.lit("m"), text(n)).alias("matchId"), text(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("timestamp"), clubs.alias("clubs"), aggregate.alias("aggregate"), F.struct(players("f").alias("1"), players("o").alias("2")).alias("players")))
    return parsed_matches(o.select(payload.alias("payload")), F.lit("1"))


LINES = """x AS (SELECT DISTINCT l_orderkey, l_linestatus, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"""
#: Rows that share a key are one player, a goalie if all of their return flags are R.
FLAGS = "y AS (SELECT l_orderkey, l_linestatus, l_linenumber, l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS q, count(DISTINCT l_returnflag) AS flags, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL)"


@query(f"""WITH {LINES}, s AS (SELECT l_orderkey, coalesce(sum(q) FILTER (l_linestatus = 'F'), 0) AS sf, coalesce(sum(q) FILTER (l_linestatus = 'O'), 0) AS so,
  coalesce(sum(l_linenumber) FILTER (l_linestatus = 'F'), 0) AS wf, coalesce(sum(l_linenumber) FILTER (l_linestatus = 'O'), 0) AS wo, coalesce(sum(q % 3) FILTER (l_linestatus = 'F'), 0) AS lf, coalesce(sum(q % 3) FILTER (l_linestatus = 'O'), 0) AS lo,
  sum(q % 5) FILTER (l_linestatus = 'F') AS pf, sum(q % 5) FILTER (l_linestatus = 'O') AS po FROM x GROUP BY 1),
f AS (SELECT *, greatest(wf, lo) AS w, greatest(lf, wo) AS l FROM s)
SELECT 'm' || o_orderkey AS match_id, '2' AS opponent_club_id, 'club ' || o_custkey AS opponent_name, CAST(epoch(o_orderdate) AS BIGINT) AS played_at,
  CASE WHEN o_orderstatus = 'P' THEN 'OTL' WHEN o_orderstatus = 'F' OR o_orderkey % 7 > o_orderkey % 5 THEN 'WIN' WHEN o_orderpriority = '5-LOW' THEN 'DNF' ELSE 'LOSS' END AS result,
  o_orderkey % 7 AS score_for, o_orderkey % 5 AS score_against, o_orderkey % 2 = 0 AS was_home, CAST(sf AS BIGINT) AS shots_for, CAST(so AS BIGINT) AS shots_against, CAST(0 AS BIGINT) AS hits_for, CAST(0 AS BIGINT) AS hits_against,
  CASE WHEN w + l > 0 THEN CAST(round(CAST(w AS DECIMAL(20,0)) * 100 / CAST(w + l AS DECIMAL(20,0)), 2) AS DOUBLE) END AS faceoff_pct, CAST(nullif(o_orderkey % 4, 0) AS BIGINT) AS time_on_attack, CAST(nullif(o_orderkey % 6, 0) AS BIGINT) AS time_on_attack_against,
  CAST(nullif(pf, 0) AS BIGINT) AS penalty_minutes, CAST(nullif(po, 0) AS BIGINT) AS penalty_minutes_against,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 5 END AS BIGINT) AS game_type, CASE o_orderkey % 3 WHEN 0 THEN '3s' WHEN 1 THEN '6s' END AS game_mode, o_orderkey % 50 AS pass_attempts, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 40 END AS pass_completions, o_orderkey % 3 AS pp_goals, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS pp_opportunities,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 60 END AS pass_attempts_against, o_orderkey % 30 AS pass_completions_against, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 2 END AS pp_goals_against, o_orderkey % 8 AS pp_opportunities_against
FROM orders JOIN f ON o_orderkey = l_orderkey""")
def payload_matches(spark, sf_dir):
    return match_rows(match_payloads(spark, sf_dir)).withColumn("played_at", F.unix_timestamp("played_at"))


@query(f"""WITH {FLAGS} SELECT 'm' || l_orderkey AS match_id, CASE l_linestatus WHEN 'F' THEN 'for' ELSE 'against' END AS side, 's' || l_suppkey AS gamertag, q AS goals, CAST(0 AS BIGINT) AS hits, CAST(l_linenumber AS BIGINT) AS faceoff_wins, q % 3 AS faceoff_losses,
q AS pass_attempts, CAST(floor(q * 0.5 + 0.5) AS BIGINT) AS pass_completions, CASE WHEN q > 10 THEN q * 10 END AS toi_seconds, CASE WHEN flags = 1 AND flag = 'R' THEN q + 1 END AS saves FROM y WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def payload_players(spark, sf_dir):
    rows = player_rows(match_payloads(spark, sf_dir))
    return rows.select("match_id", "side", "gamertag", "goals", "hits", "faceoff_wins", "faceoff_losses", "pass_attempts", "pass_completions", "toi_seconds", "saves")


@query("""WITH c AS (SELECT c_custkey AS k, c_name, CAST(c_custkey % 4 AS BIGINT) AS g, CAST(c_nationkey AS BIGINT) AS z FROM customer)
SELECT c_name AS gamertag, CASE WHEN g > 0 THEN 'goalie' END AS favorite_position, z + g AS games_played, z AS skater_gp, g AS goalie_gp, z * 2 AS goals, CAST(0 AS BIGINT) AS assists, z * 60 AS toi_seconds, CASE WHEN g > 0 THEN k % 100 END AS saves,
  CASE WHEN g > 0 THEN CAST(round(CAST('0.' || k AS DECIMAL(10,4)), 2) AS DOUBLE) END AS save_pct, CASE WHEN k % 2 = 0 THEN 16 * z END AS ice, CASE WHEN k % 2 = 0 THEN 5 END AS net FROM c""")
def payload_members(spark, sf_dir):
    k, g, z = F.col("c_custkey"), (F.col("c_custkey") % 4).cast("long"), F.col("c_nationkey").cast("long")
    put = {"name": F.col("c_name"), "favoritePosition": F.when(g > 0, "goalie"), "gamesplayed": z + g, "skgp": z, "glgp": g, "skgoals": z * 2, "skassists": F.lit(""), "sktoi": z, "glsaves": k % 100, "glsavepct": F.concat(F.lit("0."), text(k))}
    put |= {f"skShotsLocationOnIce{i}": z for i in range(1, 17)} | {f"skShotsLocationOnNet{i}": z * 4 if i < 5 else F.when(k % 2 == 0, F.lit(0)).otherwise(1) for i in range(1, 6)}
    rows = member_rows(read(spark, sf_dir, "customer").select(F.to_json(F.struct(*[text(v).alias(n) for n, v in put.items()])).alias("payload")))
    total = F.aggregate("shots_ice", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("*", total.alias("ice"), F.when(F.col("shots_net").isNotNull(), F.size("shots_net")).cast("long").alias("net")).drop("shots_ice", "shots_net")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value > 50 AS sure FROM events WHERE event_type <> 'error')
SELECT event_id AS extraction_id, CAST(slot AS BIGINT) AS slot, field_key, value, confidence FROM (
SELECT event_id, 0 AS slot, 'clock' AS field_key, event_id % 20 || ':00' AS value, 0.5 AS confidence FROM e UNION ALL SELECT event_id, 0, 'actor', 'u' || user_id, CASE WHEN sure THEN 0.75 END FROM e UNION ALL SELECT event_id, 1, 'type', event_type, NULL FROM e)""")
def payload_fields(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type <> 'error'")
    cell = lambda v, c: F.struct(v.alias("value"), c.cast("double").alias("confidence"))
    none = F.lit(None).cast("string")
    one = F.struct(cell(F.concat(text(F.col("event_id") % 20), F.lit(":00")), F.lit(0.5)).alias("clock"), cell(F.concat(F.lit("u"), text(F.col("user_id"))), F.when(F.col("value") > 50, 0.75)).alias("actor"), cell(none, F.lit(None)).alias("type"))
    two = F.struct(cell(none, F.lit(0.1)).alias("clock"), cell(none, F.lit(None)).alias("actor"), cell(F.col("event_type"), F.lit(None)).alias("type"))
    payload = F.to_json(F.struct(F.array(one, two).alias("events")))
    rows = field_rows(e.select(F.col("event_id").alias("extraction_id"), F.lit("events").alias("screen"), payload.alias("payload")), "events")
    return rows.withColumn("slot", F.col("slot").cast("long"))


@query("""SELECT o_orderkey, '{' || CASE WHEN o_orderstatus = 'P' THEN '"note":"new' ELSE '"note":"kept' END || '","score":"' || o_custkey || '"}' AS report FROM orders""")
def preserve_field(spark, sf_dir):
    stored = F.when(F.col("o_orderstatus") != "P", F.lit('{"note":"kept","score":"old"}'))
    incoming = F.to_json(F.struct(F.lit("new").alias("note"), text(F.col("o_custkey")).alias("score")))
    return read(spark, sf_dir, "orders").select("o_orderkey", keep_field(stored, incoming, "note", ["note", "score"]).alias("report"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, CASE WHEN value > 50 THEN floor(value) / 128 END AS sure FROM events),
f AS (SELECT event_id, '$.meta.title' AS path, event_type AS value, 'raw ' || event_type AS raw_text, CAST(0.5 AS DOUBLE) AS confidence, 'ok' AS status FROM e
UNION ALL SELECT event_id, '$.sides.home.players[0].tag', 'u' || user_id, NULL, sure, 'ok' FROM e UNION ALL SELECT event_id, '$.sides.home.players[0].bio.build', NULL, NULL, NULL, 'missing' FROM e
UNION ALL SELECT event_id, '$.sides.home.players[1].tag', 'v' || user_id, NULL, CAST(1 AS DOUBLE), 'ok' FROM e WHERE value > 50 UNION ALL SELECT event_id, '$.grid[0][' || n || ']', CAST(event_id % 7 + n AS VARCHAR), NULL, CAST(0.25 AS DOUBLE), 'ok' FROM e, range(2) r(n))
SELECT * FROM f""")
def nested_fields(spark, sf_dir):
    """Fields at depths of two to five in objects and arrays of the same payloads."""
    none = F.lit(None).cast("string")

    def cell(value, confidence, status=F.lit("ok"), raw=none):
        return F.struct(value.alias("value"), raw.alias("raw_text"), confidence.cast("double").alias("confidence"), status.alias("status"))

    e = read(spark, sf_dir, "events")
    sure, user = F.when(F.col("value") > 50, F.floor("value") / 128), F.col("user_id").cast("string")
    tag = lambda head, c: F.concat(F.lit(head), user) if c is None else F.when(c, F.concat(F.lit(head), user))
    one = F.struct(cell(tag("u", None), sure).alias("tag"), F.struct(cell(none, F.lit(None), none).alias("build"), F.lit("x").alias("note")).alias("bio"))
    two = F.struct(cell(tag("v", None), F.lit(1.0)).alias("tag"), F.struct(F.lit(None).cast(cell_type(e, cell)).alias("build"), F.lit("y").alias("note")).alias("bio"))
    players = F.when(F.col("value") > 50, F.array(one, two)).otherwise(F.array(one))
    grid = F.array(F.array(*[cell((F.col("event_id") % 7 + n).cast("string"), F.lit(0.25)) for n in range(2)]))
    meta = F.struct(cell(F.col("event_type"), F.lit(0.5), raw=F.concat(F.lit("raw "), F.col("event_type"))).alias("title"), F.lit(3).alias("version"))
    payload = F.to_json(F.struct(meta.alias("meta"), F.struct(F.struct(players.alias("players")).alias("home")).alias("sides"), grid.alias("grid")), {"ignoreNullFields": "false"})
    return walked_fields(e.select("event_id", payload.alias("payload")), "event_id", "payload")


def cell_type(df, cell):
    return df.select(cell(F.lit("x"), F.lit(0.0)).alias("c")).schema["c"].dataType
