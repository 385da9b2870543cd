"""Registered line-ups as shown: slots, captains, recovered bios, pooled details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ladders import rekeyed
from ..operators.lineup_reads import lineup_slots, recovered_bio
from ..sources.tables import read
from .registry import query

FRAMES = """e AS (SELECT event_id AS id, user_id AS match_id, ts, event_type AS kind, value > 50 AS own, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
s AS (SELECT id, match_id, ts, CASE WHEN id % 13 = 0 THEN ' x ' WHEN id % 11 = 0 THEN 'Cpu' WHEN id % 2 = 0 THEN 'P ' || k % 6 ELSE 'p' || k % 6 END AS gamertag, CASE WHEN id % 3 = 0 THEN k % 6 END AS player_id, CASE WHEN k % 5 > 0 THEN CASE WHEN own THEN 'for' ELSE 'against' END END AS team_side,
  kind = 'view' AS lobby, CASE k % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'LW' WHEN 2 THEN 'RW' WHEN 3 THEN 'LD' WHEN 4 THEN 'RD' WHEN 5 THEN 'G' END AS position, CASE WHEN id % 4 > 0 THEN kind END AS build, CASE WHEN id % 3 > 0 THEN 'b' || k % 2 ELSE '' END AS build_canonical,
  CASE WHEN id % 5 > 0 THEN k END AS number, CASE WHEN id % 4 = 0 THEN '5''9"' ELSE '' END AS height, CASE WHEN id % 7 = 0 THEN 180 END AS weight, id % 3 = 1 AS is_captain, id % 17 = 0 AS is_cpu, kind = 'purchase' AS reviewed, CASE WHEN id % 6 = 0 THEN 'console' END AS platform FROM e)"""
BIOS = """w AS (SELECT match_id, id, CASE WHEN k % 9 > 0 THEN 'p' || k % 6 ELSE '' END AS tag, CASE WHEN k % 3 > 0 THEN CAST(5 + k % 2 AS VARCHAR) || '''' || k % 12 || '"' END AS height, CASE WHEN 130 + k >= 140 THEN CAST(130 + k AS VARCHAR) END AS weight,
  CASE k % 4 WHEN 0 THEN 'Left' WHEN 1 THEN 'Right' END AS handedness, CASE WHEN k % 2 = 0 THEN 'p' || k % 5 || ' LVL ' || k % 10 END AS level, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 3 = 1 THEN 'Model - ' ELSE '' END || 'b' || k % 2 END AS build_canonical FROM e WHERE kind = 'click'),
l AS (SELECT * FROM (UNPIVOT w ON height, weight, handedness, level, build_canonical INTO NAME field VALUE value) WHERE tag <> ''),
b AS (SELECT match_id, tag, field, value FROM (SELECT match_id, tag, field, value, count(*) AS n, min(id) AS seen FROM l GROUP BY 1, 2, 3, 4 HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY match_id, tag, field ORDER BY n DESC, seen) = 1),
bio AS (SELECT match_id, tag, max(value) FILTER (field = 'height') AS height, max(value) FILTER (field = 'weight') AS weight, max(value) FILTER (field = 'handedness') AS handedness, max(value) FILTER (field = 'level') AS level, max(value) FILTER (field = 'build_canonical') AS build_canonical FROM b GROUP BY 1, 2)"""
SLOTS = """q AS (SELECT *, regexp_replace(lower(gamertag), '[^a-z0-9]', '', 'g') AS tag, CASE WHEN team_side IS NOT NULL THEN team_side WHEN lobby AND lower(gamertag) IN ('p1', 'p 2') THEN 'for' WHEN lobby AND lower(gamertag) IN ('p3', 'p 4') THEN 'against' WHEN player_id IS NULL THEN 'against' ELSE 'for' END AS side,
  coalesce('p' || player_id, 'g' || lower(gamertag)) AS person FROM s WHERE NOT is_cpu AND gamertag NOT IN (' x ', 'Cpu')),
g AS (SELECT *, row_number() OVER (PARTITION BY match_id, person, position IS NULL ORDER BY ts DESC, id DESC) = 1 AND position IS NOT NULL AS stands, row_number() OVER (PARTITION BY match_id ORDER BY ts DESC, id DESC) AS back FROM q),
h AS (SELECT *, min(back) OVER (PARTITION BY match_id, person) AS met FROM g),
a AS (SELECT * FROM h WHERE position IS NOT NULL AND (reviewed OR stands) QUALIFY row_number() OVER (PARTITION BY match_id, side, position ORDER BY CASE WHEN reviewed THEN 0 ELSE 1 END, CASE WHEN reviewed THEN back ELSE met END) = 1),
t AS (SELECT match_id, side, tag, place, CASE WHEN id % 5 < 3 THEN 't' || (id + place) % 9 END AS name, CASE id % 4 WHEN 0 THEN 'Elite' WHEN 1 THEN 'Specialist' END AS tier, back FROM g, range(2) r(place) WHERE id % 5 < 3 QUALIFY row_number() OVER (PARTITION BY match_id, side, tag, place ORDER BY tier IS NULL, back) = 1),
tr AS (SELECT match_id, side, tag, string_agg(place || ':' || name || ':' || coalesce(tier, '-'), ' ' ORDER BY place) AS traits FROM t GROUP BY 1, 2, 3),
v AS (SELECT match_id, side, tag, c.key AS key, c.value AS value, c.delta AS delta, back FROM (SELECT *, unnest([{'key': 'pace', 'value': CASE WHEN id % 4 > 0 THEN id % 100 END, 'delta': CASE WHEN id % 2 = 0 THEN 1 END}, {'key': 'shot', 'value': CASE WHEN id % 8 = 0 THEN 50 END, 'delta': 2}]) AS c FROM g) WHERE c.value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY match_id, side, tag, key ORDER BY back) = 1),
ab AS (SELECT match_id, side, tag, string_agg(key || ':' || value || ':' || coalesce(CAST(delta AS VARCHAR), '-'), ' ' ORDER BY key) AS attributes FROM v GROUP BY 1, 2, 3)"""
PLACE = "coalesce(list_position(['C', 'LW', 'RW', 'LD', 'RD', 'G'], position), 99)"


def frames(spark, sf_dir):
    """Events as snapshots of a user's line-up, with the tables that hang on them."""
    e = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    i, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tag = F.when(i % 13 == 0, " x ").when(i % 11 == 0, "Cpu").when(i % 2 == 0, text("P ", k % 6)).otherwise(text("p", k % 6))
    position = F.get(F.array(*[F.lit(p) for p in ("C", "LW", "RW", "LD", "RD", "G")]), (k % 7).cast("int"))
    lobby = lambda *tags: F.when(kind == "view", F.array(*map(F.lit, tags)))
    snapshots = e.select(
        F.col("user_id").alias("match_id"), i.alias("id"), F.col("ts").alias("captured_at"), tag.alias("gamertag"), F.when(i % 3 == 0, k % 6).alias("player_id"), F.when(k % 5 > 0, F.when(F.col("value") > 50, "for").otherwise("against")).alias("team_side"),
        lobby("p1", "p 2").alias("ours"), lobby("p3", "p 4").alias("theirs"), position.alias("position"), F.when(i % 4 > 0, kind).alias("build"), F.when(i % 3 > 0, text("b", k % 2)).otherwise("").alias("build_canonical"), F.when(i % 5 > 0, k).alias("number"),
        F.when(i % 4 == 0, "5'9\"").otherwise("").alias("height"), F.when(i % 7 == 0, 180).alias("weight"), F.lit(None).cast("string").alias("handedness"), F.lit("").alias("level"), F.when(i % 6 == 0, "console").alias("platform"), (i % 3 == 1).alias("is_captain"), (i % 17 == 0).alias("is_cpu"), (kind == "purchase").alias("reviewed"),
    )
    tier = F.when(i % 4 == 0, "Elite").when(i % 4 == 1, "Specialist").when(i % 4 == 2, "null")
    traits = e.filter(i % 5 < 3).select(i.alias("id"), tier.alias("tier"), F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).withColumn("name", text("t", (F.col("id") + F.col("place")) % 9))
    cell = lambda key, value, delta: F.struct(F.lit(key).alias("key"), value.cast("long").alias("value"), delta.cast("long").alias("delta"))
    attributes = e.select(i.alias("id"), F.inline(F.array(cell("pace", F.when(i % 4 > 0, i % 100), F.when(i % 2 == 0, 1)), cell("shot", F.when(i % 8 == 0, 50), F.lit(2)))))
    model = F.when(k % 3 == 1, text("Model - b", k % 2)).when(k % 3 == 2, text("b", k % 2))
    views = e.filter(kind == "click").select(
        F.col("user_id").alias("match_id"), i.alias("id"), F.when(k % 9 > 0, text("P.", k % 6)).otherwise("--").alias("gamertag"), F.when(k % 3 > 0, text("HEIGHT ", 5 + k % 2, " '", k % 12)).otherwise(text(k % 12, '"')).alias("height"),
        text(130 + k, "LBS").alias("weight"), F.when(k % 4 == 0, "SHOOTS LEFT").when(k % 4 == 1, "right").otherwise("?").alias("handedness"), F.when(k % 2 == 0, text("p", k % 5, " LVL ", k % 10)).otherwise(text("LVL", k)).alias("level"), model.alias("build_canonical"),
    )
    m = F.col("user_id").alias("match_id")
    platforms = e.filter("value > 75").select(m, F.lit("against").alias("side"), text("p", k % 6).alias("who"), kind.alias("platform")).unionByName(e.filter("value < 25").select(m, F.lit("for").alias("side"), text("", k % 6).alias("who"), kind.alias("platform")))
    return snapshots, traits, attributes, views, platforms.groupBy("match_id", "side", "who").agg(F.max("platform").alias("platform"))


@query(f"WITH {FRAMES}, {BIOS} SELECT match_id, tag, height, CAST(weight AS BIGINT) AS weight, handedness, level, build_canonical FROM bio")
def bio_recovery(spark, sf_dir):
    """What at least two loadout views of a player agree on."""
    bio = recovered_bio(frames(spark, sf_dir)[3])
    return bio.select("match_id", "tag", *[F.col(f"seen_{f}").cast("long" if f == "weight" else "string").alias(f) for f in ("height", "weight", "handedness", "level", "build_canonical")])


@query(f"""WITH {FRAMES}, {BIOS}, {SLOTS},
f AS (SELECT a.*, traits, attributes FROM a LEFT JOIN tr USING (match_id, side, tag) LEFT JOIN ab USING (match_id, side, tag) WHERE build IS NOT NULL OR number IS NOT NULL OR traits IS NOT NULL),
p AS (SELECT user_id AS match_id, 'against' AS side, 'p' || CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS who, max(event_type) AS known FROM events WHERE value > 75 GROUP BY ALL UNION ALL SELECT user_id, 'for', CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS VARCHAR), max(event_type) FROM events WHERE value < 25 GROUP BY ALL)
SELECT f.match_id, f.side, position, id, gamertag, player_id, build, number, coalesce(p.known, platform) AS platform, traits, attributes,
  CASE WHEN nullif(f.build_canonical, '') IS NULL OR bio.build_canonical = 'Model - ' || f.build_canonical THEN bio.build_canonical ELSE f.build_canonical END AS build_canonical,
  is_captain AND {PLACE} = min(CASE WHEN is_captain THEN {PLACE} END) OVER (PARTITION BY f.match_id, f.side) AS is_captain, coalesce(nullif(f.height, ''), bio.height) AS height, CAST(coalesce(CAST(f.weight AS VARCHAR), bio.weight) AS BIGINT) AS weight, bio.handedness,
  CAST(regexp_extract(bio.level, 'p([0-9]+)', 1) AS BIGINT) AS prestige, CAST(regexp_extract(bio.level, 'LVL ([0-9]+)', 1) AS BIGINT) AS level
FROM f LEFT JOIN bio USING (match_id, tag) LEFT JOIN p ON p.match_id = f.match_id AND p.side = f.side AND p.who = CASE f.side WHEN 'for' THEN CAST(player_id AS VARCHAR) ELSE f.tag END""")
def lineup_shown(spark, sf_dir):
    """Each match's slots with traits and attributes as text."""
    rows = lineup_slots(*frames(spark, sf_dir))
    line = lambda a, *fields: F.array_join(F.transform(a, lambda x: F.concat_ws(":", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])), " ")
    return rows.withColumns({"traits": line("traits", "place", "name", "tier"), "attributes": line("attributes", "key", "value", "delta")})


@query("""WITH e AS (SELECT event_id AS id, user_id AS match_id, CASE WHEN value > 50 THEN 'for' ELSE 'against' END AS side, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT *, CASE k % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'LW' WHEN 2 THEN 'RW' WHEN 3 THEN 'LD' WHEN 4 THEN 'RD' WHEN 5 THEN 'G' END AS position, CASE WHEN id % 3 = 0 THEN k % 40 END AS player_id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 > 0 THEN 1 ELSE 0 END AS detail FROM e WHERE event_type IN ('click', 'view', 'error')),
s AS (SELECT *, CASE k % 7 WHEN 0 THEN 'center' WHEN 1 THEN 'leftWing' WHEN 2 THEN 'rightWing' WHEN 3 THEN 'defenseMen' WHEN 4 THEN 'goalie' WHEN 5 THEN 'bench' END AS place, CASE WHEN id % 2 = 0 THEN k % 40 END AS player_id FROM e WHERE event_type IN ('purchase', 'signup')),
a AS (SELECT r.*, (SELECT max(id) FROM s WHERE s.match_id = r.match_id AND s.side = 'for' AND r.side = 'for' AND s.player_id = r.player_id) AS own, (SELECT min(id) FROM s WHERE s.match_id = r.match_id AND s.side = r.side AND s.k % 40 = r.k % 40) AS tagged FROM r),
b AS (SELECT a.*, coalesce(own, tagged) IS NOT NULL AS known, CASE WHEN coalesce(own, tagged) IS NULL THEN CASE a.position WHEN 'C' THEN 'C' WHEN 'LW' THEN 'W' WHEN 'RW' THEN 'D' END ELSE CASE s.place WHEN 'center' THEN 'C' WHEN 'leftWing' THEN 'W' WHEN 'rightWing' THEN 'W' WHEN 'defenseMen' THEN 'D' WHEN 'goalie' THEN 'G' END END AS slot FROM a LEFT JOIN s ON s.id = coalesce(own, tagged))
SELECT match_id, side, id, slot AS position FROM b WHERE match_id <= 75 AND slot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY match_id, side, slot ORDER BY known DESC, detail DESC, id) = 1
UNION ALL SELECT match_id, side, id, position FROM r WHERE match_id > 75""")
def ladder_slots(spark, sf_dir):
    """Matches up to 75 are of three a side, the others pass as they are."""
    e = read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    i, k = F.col("event_id"), F.col("k")
    base = [F.col("user_id").alias("match_id"), F.when(F.col("value") > 50, "for").otherwise("against").alias("side"), i.alias("id")]
    at = lambda *names: F.get(F.array(*map(F.lit, names)), (k % 7).cast("int")).alias("position")
    tag = lambda head: F.concat(F.lit(head), (k % 40).cast("string")).alias("gamertag")
    rows = e.filter(F.col("event_type").isin("click", "view", "error")).select(*base, at("C", "LW", "RW", "LD", "RD", "G"), F.when(i % 3 == 0, k % 40).alias("player_id"), tag("P. "), F.when(i % 2 == 0, "b").alias("build"), F.when(i % 5 > 0, k).alias("number"))
    stats = e.filter(F.col("event_type").isin("purchase", "signup")).select(*base, at("center", "leftWing", "rightWing", "defenseMen", "goalie", "bench"), F.when(i % 2 == 0, k % 40).alias("player_id"), tag("p"))
    return rekeyed(rows, stats, ["build", "number"], F.col("match_id") <= 75).select("match_id", "side", "id", "position")
