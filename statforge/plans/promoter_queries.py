"""Registered promotion of whole screens. Payloads are written as JSON from the tables, an order
being a frame of its customer's match, so that SQL can say from the tables alone what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.promoters import DOTS, SHOTS, STATS, ZONES, box_frames, box_score_periods, faceoff_dots, faceoff_zones, net_frames, shot_types, tracked, tracker_events
from ..sources.tables import read
from .registry import query

OURS = ["comets"]
AWAY, HOME = ["X", "Comets", "Y", "Z", "Comets"], ["X", "Y", "Comets", "COMETS 2", "Z"]
FRAMES = """f AS (SELECT o_custkey AS match_id, o_orderkey AS frame_id, o_orderkey AS i, c_nationkey AS n, CASE c_nationkey % 3 WHEN 0 THEN 'against' WHEN 1 THEN 'for' ELSE CASE o_orderkey % 5 WHEN 1 THEN 'for' WHEN 4 THEN 'for' WHEN 2 THEN 'against' WHEN 3 THEN 'against' END END AS away_is,
  CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_orderkey % 5 END AS period, CASE WHEN o_orderkey % 9 > 0 THEN 'P' || o_orderkey % 5 END AS label FROM orders JOIN customer ON c_custkey = o_custkey)"""
CELLS = "c AS (SELECT l_orderkey AS frame_id, l_linenumber AS line, CAST(max(l_quantity) AS BIGINT) AS q, max(l_discount) AS d, max(l_suppkey) AS k FROM lineitem GROUP BY 1, 2)"
FIRST = "first({0} ORDER BY frame_id) FILTER ({0} IS NOT NULL) AS {0}"


def field(value, ok=True):
    """A field as readers of screens write it."""
    return F.struct(value.alias("value"), F.when(F.lit(ok), "ok").otherwise("uncertain").alias("status"))


def frames(spark, sf_dir):
    """match_id, frame_id, i, n, period and label of every order; a customer is a match."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    i = F.col("o_orderkey")
    period = F.when(F.col("o_orderstatus") == "P", -1).otherwise(i % 5)
    label = field(F.when(i % 9 > 0, F.concat(F.lit("P"), (i % 5).cast("string"))))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("match_id"), i.alias("frame_id"), i.alias("i"), F.col("c_nationkey").alias("n"), period.alias("period"), label.alias("label"))


def matches(spark, sf_dir):
    n = F.col("c_nationkey") % 3
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("match_id"), F.when(n < 2, n == 0).alias("was_home"), F.lit("Nobody").alias("opponent"))


def named(names):
    return field(F.get(F.array(*map(F.lit, names)), (F.col("i") % 5).cast("int")))


def with_cells(spark, sf_dir, cell):
    """Frames with ``cells``, ``cell`` of each line of the order in the order of lines."""
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_discount").alias("d"), F.max("l_suppkey").alias("k"))
    cells = x.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", cell.alias("c")))), lambda s: s["c"]).alias("cells"))
    return frames(spark, sf_dir).join(cells, "frame_id", "left")


def box_scores(spark, sf_dir):
    line, q, d, k = F.col("line"), F.col("q"), F.col("d"), F.col("k")
    cell = F.struct(F.concat(F.lit("P"), line.cast("string")).alias("period_label"), F.when(line == 7, -1).otherwise(line).alias("period_number"), field(F.when(d < 0.08, q)).alias("away_value"), field(F.when(d > 0.02, k % 10)).alias("home_value"))
    kind = F.get(F.array(*map(F.lit, [*STATS, "saves"])), (F.col("i") % 4).cast("int"))
    payload = F.struct(kind.alias("stat_kind"), named(AWAY).alias("away_team"), named(HOME).alias("home_team"), F.col("cells").alias("periods"))
    return with_cells(spark, sf_dir, cell).select("match_id", "frame_id", F.to_json(payload).alias("payload"))


BOX_COLUMNS = [f"{k}_{s}" for k in STATS for s in ("for", "against")]
BOX_VALUES = ", ".join(f"CASE WHEN i % 4 = {j} THEN CASE WHEN (away_is = 'for') = {s == 'for'} THEN away ELSE home END END AS {k}_{s}" for j, k in enumerate(STATS) for s in ("for", "against"))


@query(f"""WITH {FRAMES}, {CELLS}, r AS (SELECT match_id, f.frame_id, line, away_is, i, CASE WHEN d < 0.08 THEN q END AS away, CASE WHEN d > 0.02 THEN k % 10 END AS home FROM f JOIN c ON c.frame_id = f.frame_id WHERE i % 4 < 3 AND away_is IS NOT NULL AND line < 7),
v AS (SELECT match_id, frame_id, line, {BOX_VALUES} FROM r) SELECT match_id, CAST(line AS INTEGER) AS period_number, 'P' || line AS period_label, min(frame_id) AS frame_id, {", ".join(FIRST.format(c) for c in BOX_COLUMNS)} FROM v GROUP BY match_id, line""")
def box_score_promotion(spark, sf_dir):
    return box_score_periods(box_scores(spark, sf_dir), matches(spark, sf_dir), OURS)


def nets(spark, sf_dir):
    i, n = F.col("i"), F.col("n")
    away = F.struct(*[field(F.when((i + j) % 7 > 0, (i * (j + 3) + n) % 17)).alias(c) for j, c in enumerate(SHOTS)])
    home = F.struct(*[field(F.when((i + j) % 6 > 0, i * (j + 5) % 13)).alias(c) for j, c in enumerate(SHOTS)])
    payload = F.struct(
        F.col("period").alias("period_number"), F.col("label").alias("period_label"), named(AWAY).alias("away_label"), named(HOME).alias("home_label"), field(F.when(i % 3 > 0, i % 40)).alias("away_header_total_shots"),
        field(F.when(i % 4 > 0, i % 30)).alias("home_header_total_shots"), away.alias("away"), F.when(i % 11 > 0, home).alias("home"),
    )
    return frames(spark, sf_dir).select("match_id", "frame_id", F.to_json(payload).alias("payload"))


NET_AWAY = ", ".join(f"CASE WHEN (i + {j}) % 7 > 0 THEN (i * {j + 3} + n) % 17 END AS {c}" for j, c in enumerate(SHOTS))
NET_HOME = ", ".join(f"CASE WHEN (i + {j}) % 6 > 0 THEN i * {j + 5} % 13 END AS {c}" for j, c in enumerate(SHOTS))
FIRSTS, NAMES = ", ".join(FIRST.format(c) for c in SHOTS), ", ".join(SHOTS)


@query(f"""WITH {FRAMES}, g AS (SELECT * FROM f WHERE period <> 0 AND away_is IS NOT NULL AND i % 11 > 0),
r AS (SELECT match_id, frame_id, period, label, away_is AS team_side, CASE WHEN i % 3 > 0 THEN i % 40 END AS header, {NET_AWAY} FROM g UNION ALL SELECT match_id, frame_id, period, label, CASE away_is WHEN 'for' THEN 'against' ELSE 'for' END, CASE WHEN i % 4 > 0 THEN i % 30 END, {NET_HOME} FROM g),
p AS (SELECT match_id, team_side, period, last(label ORDER BY frame_id) AS period_label, min(frame_id) AS frame_id, {FIRSTS} FROM r WHERE period > 0 GROUP BY 1, 2, 3),
l AS (SELECT match_id, team_side, max(frame_id) AS last, last(header ORDER BY frame_id) AS header FROM r WHERE period > 0 GROUP BY 1, 2),
s AS (SELECT match_id, team_side, -1 AS period, 'ALL PERIODS' AS label, any_value(last) AS frame_id, coalesce(any_value(header), CASE WHEN count(*) = count(total_shots) THEN sum(total_shots) END) AS total_shots, {", ".join(f"CASE WHEN count(*) = count({c}) THEN sum({c}) END AS {c}" for c in SHOTS[1:])} FROM p JOIN l USING (match_id, team_side) GROUP BY 1, 2),
w AS (SELECT match_id, team_side, period, label, frame_id, {NAMES} FROM s UNION ALL SELECT match_id, team_side, period, label, frame_id, {NAMES} FROM r LEFT JOIN l USING (match_id, team_side) WHERE period = -1 AND (last IS NULL OR frame_id > last))
SELECT match_id, team_side, CAST(period AS INTEGER) AS period_number, period_label, frame_id, {NAMES} FROM p UNION ALL SELECT match_id, team_side, -1, last(label ORDER BY frame_id), min(frame_id), {", ".join(f"CAST(first({c} ORDER BY frame_id) FILTER ({c} IS NOT NULL) AS BIGINT)" for c in SHOTS)} FROM w GROUP BY 1, 2""")
def shot_type_promotion(spark, sf_dir):
    return shot_types(nets(spark, sf_dir), matches(spark, sf_dir), OURS)


@query(f"""WITH {FRAMES} SELECT frame_id, 'box' AS screen, CASE WHEN i % 4 = 3 THEN 'kind' WHEN away_is IS NULL THEN 'side' ELSE 'cells' END AS fault FROM f WHERE i % 4 = 3 OR away_is IS NULL OR frame_id NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT frame_id, 'net', CASE WHEN period = 0 THEN 'period' WHEN away_is IS NULL THEN 'side' ELSE 'blocks' END FROM f WHERE period = 0 OR away_is IS NULL OR i % 11 = 0""")
def frame_faults(spark, sf_dir):
    """Frames that are not promoted, and why."""
    m = matches(spark, sf_dir)
    bad = lambda rows, name: rows.filter("fault IS NOT NULL").select("frame_id", F.lit(name).alias("screen"), "fault")
    return bad(box_frames(box_scores(spark, sf_dir), m, OURS), "box").unionByName(bad(net_frames(nets(spark, sf_dir), m, OURS), "net"))


def maps(spark, sf_dir):
    i = F.col("i")
    sure = lambda j: (i + j) % 5 > 0
    block = lambda a, b: F.struct(field((i * a % 801).cast("double") / 8, sure(0)).alias("overall_win_pct"), *[field(F.when((i + j) % b > 0, i * (j + a) % 19), sure(j)).alias(c) for j, c in enumerate(ZONES)])
    dots = F.map_from_entries(F.array(*[F.struct(F.lit(d), F.struct(field(i * (j + 2) % 7, sure(j)).alias("away_wins"), field(F.when((i + j) % 3 > 0, i % 5), sure(j + 1)).alias("home_wins"))) for j, d in enumerate(DOTS[:7])]))
    payload = F.struct(F.col("period").alias("period_number"), F.col("label").alias("period_label"), block(3, 4).alias("away"), F.when(i % 7 > 0, block(5, 6)).alias("home"), dots.alias("dots"))
    return frames(spark, sf_dir).select("match_id", "frame_id", F.to_json(payload).alias("payload"))


ZONE_VALUES = lambda a, b: ", ".join([f"(i * {a} % 801 * 200 + 8) // 16 / 100.0 AS overall_win_pct", *[f"CASE WHEN (i + {j}) % 5 > 0 AND (i + {j}) % {b} > 0 THEN i * {j + a} % 19 END AS {c}" for j, c in enumerate(ZONES)]])


@query(f"""WITH {FRAMES}, r AS (SELECT match_id, frame_id, period, label, 'away' AS team_side, {ZONE_VALUES(3, 4)} FROM f WHERE period <> 0 UNION ALL SELECT match_id, frame_id, period, label, 'home', {ZONE_VALUES(5, 6)} FROM f WHERE period <> 0 AND i % 7 > 0)
SELECT match_id, CAST(period AS INTEGER) AS period_number, team_side, last(label ORDER BY frame_id) AS period_label, min(frame_id) AS frame_id, {", ".join(FIRST.format(c) for c in ["overall_win_pct", *ZONES])} FROM r GROUP BY match_id, period, team_side""")
def faceoff_zone_promotion(spark, sf_dir):
    return faceoff_zones(maps(spark, sf_dir)).withColumn("overall_win_pct", F.col("overall_win_pct").cast("double"))


@query(f"""WITH {FRAMES}, x AS (SELECT unnest({DOTS}) AS dot_id, unnest(range({len(DOTS)})) AS j), r AS (SELECT match_id, frame_id, period, label, dot_id, CASE WHEN j < 7 AND (i + j) % 5 > 0 THEN i * (j + 2) % 7 END AS away_wins, CASE WHEN j < 7 AND (i + j + 1) % 5 > 0 AND (i + j) % 3 > 0 THEN i % 5 END AS home_wins FROM f CROSS JOIN x WHERE period <> 0)
SELECT match_id, CAST(period AS INTEGER) AS period_number, dot_id, last(label ORDER BY frame_id) AS period_label, min(frame_id) AS frame_id, {FIRST.format("away_wins")}, {FIRST.format("home_wins")} FROM r GROUP BY match_id, period, dot_id""")
def faceoff_dot_promotion(spark, sf_dir):
    return faceoff_dots(maps(spark, sf_dir))


KINDS = ["shot", "hit", "unknown", "goal", "unknown", "unknown", "unknown", "unknown"]
RAW = ["a", "b", "late SH0T on", "c", "GDAL 2", "L0HS", "H1T", "smudge"]
PATHS = ["/in/1st/a.png", "in\\2nd period\\b.png", "in/OT/c.png", "d.png"]


def event_frames(spark, sf_dir):
    q, d, k, line = F.col("q"), F.col("d"), F.col("k"), F.col("line")
    pick = lambda words, c: F.get(F.array(*map(F.lit, words)), c.cast("int"))
    clock = F.when(d < 0.09, F.concat((q % 4).cast("string"), F.lit(":0"), (k % 2).cast("string")))
    cell = F.struct(
        F.lit("").alias("period_label"), (line % 4).alias("period_number"), pick(KINDS, k % 8).alias("event_type"), field(pick(RAW, k % 8)).alias("raw_text"), field(clock).alias("clock"),
        field(F.when(q % 10 > 0, F.concat(F.lit("Sup "), (k % 6).cast("string")))).alias("actor_snapshot"), field(F.when(q % 3 == 0, F.concat(F.lit("SUP"), (q % 8).cast("string")))).alias("target_snapshot"),
    )
    i = F.col("i")
    marks = {"x": F.when(i % 4 > 0, (i % 200) / 8.0), "y": (i % 80) / 8.0, "rink_zone": F.lit("neutral"), "confidence": F.when(i % 3 > 0, (i % 3) * 0.3), "index": (i % 7).cast("int")}
    payload = F.struct(F.col("cells").alias("events"), *[c.alias(f"selected_event_{m}") for m, c in marks.items()])
    return with_cells(spark, sf_dir, cell).select("match_id", "frame_id", pick(PATHS, i % 4).alias("path"), F.to_json(payload).alias("payload"))


def rosters(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("sup-"), (k % 4).cast("string")).alias("tag"), k.alias("player_id"))


@query(f"""WITH {FRAMES}, {CELLS}, g AS (SELECT f.match_id, f.frame_id, i, row_number() OVER (PARTITION BY f.frame_id ORDER BY line) - 1 AS pos, list_extract({KINDS}, CAST(k % 8 + 1 AS INTEGER)) AS kind, CASE k % 8 WHEN 2 THEN 'shot' WHEN 4 THEN 'goal' WHEN 5 THEN 'shot' WHEN 6 THEN 'hit' END AS guess,
  CASE WHEN line % 4 > 0 THEN line % 4 ELSE CASE i % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 0 END END AS period, CASE WHEN d < 0.09 THEN q % 4 || ':0' || k % 2 END AS clock, CASE WHEN q % 10 > 0 THEN 'Sup ' || k % 6 END AS actor, CASE WHEN q % 3 = 0 THEN 'SUP' || q % 8 END AS target FROM f JOIN c ON c.frame_id = f.frame_id),
u AS (SELECT s_suppkey % 4 AS digit, min(s_suppkey) AS player_id FROM supplier GROUP BY 1), e AS (SELECT *, CASE WHEN kind = 'unknown' THEN coalesce(guess, 'unknown') ELSE kind END AS event_type, pos = i % 7 AS marked FROM g)
SELECT frame_id, CAST(pos AS INTEGER) AS pos, CAST(period AS BIGINT) AS period_number, clock, event_type, actor, a.player_id AS actor_id, target, t.player_id AS target_id, marked, CASE WHEN marked AND i % 4 > 0 THEN i % 200 / 8.0 END AS x, CASE WHEN marked AND i % 4 > 0 THEN i % 80 / 8.0 END AS y,
CASE WHEN event_type = 'unknown' THEN 'type' WHEN clock IS NULL THEN 'clock' WHEN actor IS NULL THEN 'actor' WHEN period < 1 THEN 'period' END AS fault FROM e LEFT JOIN u a ON 'Sup ' || a.digit = actor LEFT JOIN u t ON 'SUP' || t.digit = target""")
def tracker_readings(spark, sf_dir):
    """Events of list screens with kinds recovered from misread tags, periods from folders, ids from tags."""
    rows = tracked(event_frames(spark, sf_dir), rosters(spark, sf_dir))
    return rows.select("frame_id", "pos", F.col("period_number").cast("long").alias("period_number"), "clock", "event_type", "actor", "actor_id", "target", "target_id", "marked", "x", "y", "fault")


@query()
def tracker_promotion(spark, sf_dir):
    """Those readings against stored events, made of the table of events, and each other."""
    e = read(spark, sf_dir, "events")
    number = F.from_json("props", "k long")["k"]
    clock = F.concat((F.col("event_id") % 4).cast("string"), F.lit(":0"), (number % 2).cast("string"))
    stored = e.select((F.col("event_id") + 1).alias("id"), F.col("user_id").alias("match_id"), (number % 4 + 1).alias("period_number"), F.when(F.col("event_type") == "click", "shot").otherwise("hit").alias("event_type"), clock.alias("clock"), F.lit(None).cast("long").alias("actor_id"), F.concat(F.lit("Sup "), (number % 6).cast("string")).alias("actor"))
    return tracker_events(tracked(event_frames(spark, sf_dir), rosters(spark, sf_dir)), stored)
