"""Registered truth layer and opponents' colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors as C
from ..operators.truth import PLAYER, TEAM, truth_diffs, truth_layer
from ..sources.tables import dealt, read
from .registry import query

#: Read totals of an order (a match) and true ones, and the same for its lines (players).
TOTALS = """o AS (SELECT o_orderkey AS i, o_custkey AS c, o_orderstatus AS s FROM orders), l AS (SELECT l_orderkey AS i, l_linenumber AS n, CAST(max(l_quantity) AS BIGINT) AS q, max(l_suppkey) AS k, max(l_discount) AS d FROM lineitem GROUP BY 1, 2),
t AS (SELECT i, [c % 7, c % 5, CASE WHEN c % 6 > 0 THEN i % 30 END, i % 28, 20, 21] AS v FROM o WHERE s <> 'P'), r AS (SELECT i, [c % 7, CASE WHEN i % 4 > 0 THEN c % 5 ELSE 9 END, i % 30, CASE WHEN i % 3 > 0 THEN i % 28 END, 20, CASE WHEN i % 5 > 0 THEN 21 ELSE 12 END] AS v FROM o WHERE i % 8 > 0),
p AS (SELECT i, n, CASE WHEN d < 0.09 THEN n END AS player, [q % 4, CASE WHEN d > 0.01 THEN q % 3 END, k % 20, 80 + q % 10] AS v, [CASE WHEN k % 9 > 0 THEN q % 4 ELSE 5 END, q % 3, k % 20, 80 + q % 10 + (k % 3) * 0.0078125] AS w FROM l)"""
DIFFS = f"""{TOTALS}, d AS (SELECT t.i AS match_id, 'team' AS scope, unnest({TEAM}) AS field, unnest(r.v) AS read, unnest(t.v) AS truth, 0.0 AS within FROM t JOIN r USING (i)
UNION ALL SELECT i, 'player:p' || n, unnest({PLAYER}), unnest(p.v), unnest(p.w), unnest([0, 0, 0, 0.01]) FROM p JOIN t USING (i) WHERE player IS NOT NULL),
g AS (SELECT match_id, scope, field, CAST(read AS DOUBLE) AS read, CAST(truth AS DOUBLE) AS truth, abs(read - truth) <= within AS matched FROM d WHERE read IS NOT NULL AND truth IS NOT NULL)"""


def totals(spark, sf_dir):
    """(all matches, read teams, read players, true teams, true players) as in ``TOTALS``."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    i, c = F.col("i"), F.col("c")
    named = lambda names, values: [v.alias(n) for n, v in zip(names, values, strict=True)]
    true_teams = o.filter("s <> 'P'").select("match_id", *named(TEAM, [c % 7, c % 5, F.when(c % 6 > 0, i % 30), i % 28, F.lit(20), F.lit(21)]))
    teams = o.filter(i % 8 > 0).select("match_id", *named(TEAM, [c % 7, F.when(i % 4 > 0, c % 5).otherwise(9), i % 30, F.when(i % 3 > 0, i % 28), F.lit(20), F.when(i % 5 > 0, 21).otherwise(12)]))
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_suppkey").alias("k"), F.max("l_discount").alias("d"))
    q, k, d, n = (F.col(a) for a in "qkdn")
    players = x.select("match_id", F.concat(F.lit("p"), n.cast("string")).alias("tag"), F.when(d < 0.09, n).alias("player_id"), *named(PLAYER, [q % 4, F.when(d > 0.01, q % 3), k % 20, 80 + q % 10]))
    true_players = x.select("match_id", n.alias("player_id"), *named(PLAYER, [F.when(k % 9 > 0, q % 4).otherwise(5), q % 3, k % 20, 80 + q % 10 + (k % 3) * 0.0078125]))
    return o, teams, players, true_teams, true_players


@query(f"WITH {DIFFS} SELECT * FROM g WHERE NOT matched")
def truth_mismatches(spark, sf_dir):
    """Fields whose reading differs from the payload, for review."""
    _, teams, players, true_teams, true_players = totals(spark, sf_dir)
    return truth_diffs(teams, players, true_teams, true_players).filter("NOT matched")


@query(f"""WITH {DIFFS}, a AS (SELECT match_id, count(*) AS fields, count_if(matched) AS matched FROM g GROUP BY 1), f AS (SELECT i, CASE WHEN i % 9 > 0 THEN c % 7 END AS gf, CASE WHEN i % 7 = 0 THEN 8 ELSE c % 5 END AS ga FROM o WHERE i % 10 > 0),
z AS (SELECT o.i AS match_id, t.i IS NOT NULL AS gradable, coalesce(fields, 0) AS fields, coalesce(matched, 0) AS matched, CASE WHEN t.i IS NOT NULL AND gf IS NOT NULL THEN (CAST(gf = t.v[1] AS INTEGER) + CAST(ga = t.v[2] AS INTEGER)) / 2.0 END AS final_accuracy FROM o LEFT JOIN t ON t.i = o.i LEFT JOIN a ON a.match_id = o.i LEFT JOIN f ON f.i = o.i)
SELECT match_id, gradable, fields, matched, CASE WHEN fields > 0 THEN CAST(matched AS DOUBLE) / fields END AS score, CASE WHEN fields > 0 THEN CAST(matched AS DOUBLE) / fields >= 0.95 END AS passed, CAST(final_accuracy AS DOUBLE) AS final_accuracy,
CASE WHEN final_accuracy = 1 THEN 'PASS' WHEN final_accuracy IS NULL AND NOT gradable THEN 'OPERATOR_CONFIRM' ELSE 'HOLD' END AS gate FROM z""")
def truth_scores(spark, sf_dir):
    """The truth layer of every match and the gate by its final score."""
    o, teams, players, true_teams, true_players = totals(spark, sf_dir)
    i, c = F.col("i"), F.col("c")
    finals = o.filter(i % 10 > 0).select("match_id", F.when(i % 9 > 0, c % 7).alias("goals_for"), F.when(i % 7 == 0, 8).otherwise(c % 5).alias("goals_against"))
    return truth_layer(o, truth_diffs(teams, players, true_teams, true_players), true_teams, finals)


def times(matrix, v):
    return [" + ".join(f"({m} * ({x}))" for m, x in zip(row, v, strict=True)) for row in matrix]


def lch_sql(rgb, p):
    """SQL columns l, c, h (with prefix p) of an OKLCH colour from three channels."""
    linear = [f"CASE WHEN {x} / 255.0 <= 0.04045 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END" for x in rgb]
    light, a, b = times(C.LMS_TO_LAB, [f"cbrt({x})" for x in times(C.RGB_TO_LMS, linear)])
    return f"{light} AS {p}l, sqrt(pow({a}, 2) + pow({b}, 2)) AS {p}c, (degrees(atan2({b}, {a})) + 360) % 360 AS {p}h"


def fails_sql(p):
    gap = f"least(abs({p}h - 29), 360 - abs({p}h - 29))"
    return f"(({gap} <= 30 AND {p}c >= 0.05) OR {p}l < 0.55 OR ({p}l > 0.93 AND {p}c < 0.045))", f"({gap} <= 30 AND {p}c >= 0.05)"


#: Clubs whose colours a task works out; files of parts are small and few.
CLUBS = 20_000
A, B = "tc * j * cos(radians(th))", "tc * j * sin(radians(th))"
OUT = [f"255 * CASE WHEN {x} <= 0.0031308 THEN ({x}) * 12.92 ELSE 1.055 * pow(greatest({x}, 0), 1 / 2.4) - 0.055 END" for x in times(C.LMS_TO_RGB, [f"pow({x}, 3)" for x in times(C.LAB_TO_LMS, ["tl", A, B])])]
HEX = "'#' || printf('%02X%02X%02X', {0}, {1}, {2})"


@query(f"""WITH k AS (SELECT p_partkey AS k, p_brand AS brand, p_partkey * 37 % 256 AS r, p_partkey * 53 % 256 AS g, p_partkey * 91 % 256 AS b, p_partkey % 9 AS w FROM part),
a AS (SELECT k, brand, w, CASE w WHEN 3 THEN r % 70 WHEN 4 THEN 240 + r % 16 WHEN 5 THEN r // 16 * 17 ELSE r END AS r1, CASE w WHEN 2 THEN r WHEN 3 THEN g % 70 WHEN 4 THEN 240 + g % 16 WHEN 5 THEN g // 16 * 17 ELSE g END AS g1, CASE w WHEN 2 THEN r WHEN 3 THEN b % 70 WHEN 4 THEN 240 + b % 16 WHEN 5 THEN b // 16 * 17 ELSE b END AS b1, k % 4 > 0 AS two, k * 29 % 256 AS r2, k * 67 % 256 AS g2, k * 13 % 256 AS b2 FROM k),
f AS (SELECT k, brand, w > 1 AS one, two AND w > 1 AS second, w > 1 OR two AS has, CASE WHEN w > 1 THEN r1 ELSE r2 END AS r, CASE WHEN w > 1 THEN g1 ELSE g2 END AS g, CASE WHEN w > 1 THEN b1 ELSE b2 END AS b, r2, g2, b2 FROM a),
o AS (SELECT *, {lch_sql("rgb", "")}, {lch_sql(("r2", "g2", "b2"), "s")} FROM f),
x AS (SELECT *, CASE WHEN has AND NOT {fails_sql("")[0]} THEN 'brand' WHEN second AND NOT {fails_sql("s")[0]} THEN 'secondary' WHEN NOT has OR {fails_sql("")[1]} THEN 'alternate' WHEN l > 0.93 AND c < 0.045 THEN 'pale' WHEN c < 0.03 THEN 'gunmetal' ELSE 'lifted' END AS rung FROM o),
t AS (SELECT k, CASE rung WHEN 'pale' THEN 0.86 ELSE 0.62 END AS tl, CASE rung WHEN 'pale' THEN greatest(c, 0.035) WHEN 'gunmetal' THEN 0.012 ELSE greatest(least(c, 0.14), 0.06) END AS tc, CASE WHEN rung = 'gunmetal' OR (rung = 'pale' AND c < 0.02) THEN 250 ELSE h END AS th FROM x WHERE rung IN ('pale', 'gunmetal', 'lifted')),
u AS (SELECT k, i, {", ".join(f"{c} AS {n}" for n, c in zip(("r", "g", "b"), OUT, strict=True))} FROM t CROSS JOIN (SELECT i, CASE WHEN i < 40 THEN pow(0.94, i) ELSE 0 END AS j FROM range(41) q(i))),
v AS (SELECT k, arg_min([r, g, b], i) AS v FROM u WHERE i = 40 OR (least(r, g, b) >= -0.5 AND greatest(r, g, b) <= 255.5) GROUP BY 1),
y AS (SELECT x.k, rung, CASE rung WHEN 'brand' THEN [r, g, b] WHEN 'secondary' THEN [r2, g2, b2] WHEN 'alternate' THEN [[143, 166, 196], [111, 183, 216], [155, 140, 232], [110, 143, 232]][CAST(list_reduce(list_prepend(0, list_transform(string_split(upper(brand), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda n, ch: (n * 31 + ch) % 4294967296) % 4 AS INTEGER) + 1] ELSE list_transform(v, lambda z: CAST(floor(greatest(0, least(255, z)) + 0.5) AS BIGINT)) END AS m FROM x LEFT JOIN v ON v.k = x.k),
m AS (SELECT k, rung, CAST(m[1] AS BIGINT) AS r, CAST(m[2] AS BIGINT) AS g, CAST(m[3] AS BIGINT) AS b FROM y), e AS (SELECT *, {lch_sql("rgb", "")} FROM m)
SELECT k, {HEX.format(*"rgb")} AS base, 'rgba(' || r || ', ' || g || ', ' || b || ', 0.12)' AS soft, CASE WHEN l >= 0.6 THEN '#1A1819' ELSE '#EBEBEB' END AS fg, CASE WHEN rung IN ('pale', 'lifted') THEN 'adjusted' ELSE rung END AS provenance FROM e""")
def club_palette(spark, sf_dir):
    """A part is a club: its brand is the abbreviation, its key gives two colours."""
    k, w = F.col("p_partkey"), F.col("p_partkey") % 9
    r, g, b = (k * m % 256 for m in (37, 53, 91))
    shade = lambda x: F.when(w == 2, r).when(w == 3, x % 70).when(w == 4, 240 + x % 16).when(w == 5, F.floor(x / 16) * 17).otherwise(x)
    short = F.format_string("%x%x%x", *[F.floor(x / 16) for x in (r, g, b)])
    home = F.when(w == 0, F.lit(None)).when(w == 1, "#none").when(w == 5, short).otherwise(F.format_string("#%02x%02x%02x", *map(shade, (r, g, b))))
    away = F.when(k % 4 > 0, F.format_string(" %02X%02X%02X", *[k * m % 256 for m in (29, 67, 13)]))
    clubs = dealt(read(spark, sf_dir, "part"), "p_partkey", rows=CLUBS).select(k.alias("k"), "p_brand", home.alias("home"), away.alias("away"))
    return C.opponent_colors(clubs, "p_brand", "home", "away").select("k", "colors.base", "colors.soft", "colors.fg", "colors.provenance")
