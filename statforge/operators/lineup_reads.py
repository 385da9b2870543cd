"""The line-up of a match as it is shown: one snapshot a slot, its gaps filled from other frames.

Snapshots: match_id, id, captured_at, gamertag, player_id, team_side (for, against or null),
ours and theirs (lower-case tags of the lobby's rosters, or null), position, build,
build_canonical, number, height, weight, handedness, level, platform, is_captain, is_cpu, reviewed.
A null captured_at is the oldest, and the larger id is the newer of equal times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import body_weight, handedness, height_text, level_parts
from ..functions.text import plain_tag

#: Tags that are no players, tiers of a trait, positions in the order of a roster.
NO_PLAYERS = ["away", "home", "cpu", "?", "(unknown)"]
TIERS = ["Elite", "All Star", "Specialist"]
POSITIONS = ["C", "LW", "RW", "LD", "RD", "G"]
BIO = ["height", "weight", "handedness", "level", "build_canonical"]
SIDE, SLOT = ["match_id", "side"], ["match_id", "side", "position"]


def side_of() -> Column:
    """The side written down, else the roster that names the player, else ours for known players."""
    tag = F.lower("gamertag")
    names = lambda roster: (tag != "") & F.coalesce(F.array_contains(roster, tag), F.lit(False))
    return F.coalesce("team_side", F.when(names("ours"), "for").when(names("theirs"), "against"), F.when(F.col("player_id").isNotNull(), "for").otherwise("against"))


def playing(snapshots: DataFrame) -> DataFrame:
    """Snapshots of people, with side, tag, age (newest largest) and pool, the tag under
    which details are shared; without letters or digits a snapshot shares with none."""
    name = F.trim("gamertag")
    people = snapshots.filter(~F.coalesce("is_cpu", F.lit(False)) & (F.length(name) > 1) & ~F.lower(name).isin(NO_PLAYERS))
    tag = plain_tag(F.col("gamertag"))
    pool = F.when(tag != "", tag).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    return people.withColumns({"side": side_of(), "tag": tag, "age": F.struct("captured_at", "id"), "pool": pool})


def slot_snapshots(people: DataFrame) -> DataFrame:
    """match_id, side, position and the id that fills the slot: the newest reviewed snapshot;
    without one, each player stands where their newest placed snapshot is, and of several
    players the one who was seen last."""
    placed = F.col("position").isNotNull() & (F.col("position") != "")
    reviewed = people.filter(placed & F.col("reviewed")).select(*SLOT, F.lit(1).alias("own"), "age", "id")
    who = F.coalesce(F.concat(F.lit("p:"), F.col("player_id").cast("string")), F.concat(F.lit("g:"), F.lower("gamertag")))
    last = F.max(F.when(placed, F.struct("age", "side", "position", "id"))).alias("s")
    players = people.groupBy("match_id", who.alias("who")).agg(F.max("age").alias("age"), last).filter("s IS NOT NULL")
    others = players.select("match_id", "s.side", "s.position", F.lit(0).alias("own"), "age", "s.id")
    return reviewed.unionByName(others).groupBy(*SLOT).agg(F.max(F.struct("own", "age", "id")).alias("b")).select(*SLOT, F.col("b.id").alias("id"))


def pooled_traits(people: DataFrame, traits: DataFrame) -> DataFrame:
    """traits (id, place, name, tier) of a pool: for each place the newest reading with a real
    tier, else the newest; a tier outside ``TIERS`` is null."""
    tier = F.when(F.col("tier").isin(TIERS), F.col("tier"))
    rows = people.select("id", *SIDE, "pool", "age").join(traits.select("id", "place", "name", tier.alias("tier")), "id")
    best = rows.groupBy(*SIDE, "pool", "place").agg(F.max_by(F.struct("name", "tier"), F.struct(F.col("tier").isNotNull().alias("real"), "age")).alias("t"))
    return best.groupBy(*SIDE, "pool").agg(F.sort_array(F.collect_list(F.struct("place", "t.name", "t.tier"))).alias("traits"))


def pooled_attributes(people: DataFrame, attributes: DataFrame) -> DataFrame:
    """attributes (id, key, value, delta) of a pool: the newest value that is not null, with its delta."""
    rows = people.select("id", *SIDE, "pool", "age").join(attributes.filter("value IS NOT NULL").select("id", "key", "value", "delta"), "id")
    best = rows.groupBy(*SIDE, "pool", "key").agg(F.max_by(F.struct("value", "delta"), "age").alias("v"))
    return best.groupBy(*SIDE, "pool").agg(F.sort_array(F.collect_list(F.struct("key", "v.value", "v.delta"))).alias("attributes"))


def recovered_bio(views: DataFrame, support: int = 2) -> DataFrame:
    """match_id, tag and the fields of ``BIO`` on which at least ``support`` views agree: the
    most frequent value, of ties the one seen first. views: match_id, id, gamertag and the
    fields as read. A level counts only with its prestige."""
    level = F.when(level_parts(F.col("level"))[0].isNotNull(), F.col("level"))
    build = F.nullif(F.trim("build_canonical"), F.lit(""))
    values = {"height": height_text(F.col("height")), "weight": body_weight(F.col("weight")).cast("string"), "handedness": handedness(F.col("handedness")), "level": level, "build_canonical": build}
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()]))
    rows = views.select("match_id", plain_tag(F.col("gamertag")).alias("tag"), "id", cells).filter("tag <> '' AND value IS NOT NULL")
    votes = rows.groupBy("match_id", "tag", "field", "value").agg(F.count("*").alias("n"), F.min("id").alias("seen")).filter(F.col("n") >= support)
    best = votes.groupBy("match_id", "tag", "field").agg(F.max_by("value", F.struct("n", -F.col("seen"))).alias("value"))
    return best.groupBy("match_id", "tag").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"seen_{f}") for f in BIO])


def fuller_build(stored: Column, seen: Column) -> Column:
    """The stored build; the one seen where none is stored or where it is the same build and
    only it names a model ('model - build')."""
    mark = F.lit(" - ")
    build = lambda c: F.regexp_replace(c, "^.*? - ", "")
    same = ~F.contains(stored, mark) & F.contains(seen, mark) & (stored == build(seen))
    return F.when(stored.isNull() | F.coalesce(same, F.lit(False)), seen).otherwise(stored)


def lineup_slots(snapshots: DataFrame, traits: DataFrame, attributes: DataFrame, views: DataFrame, platforms: DataFrame) -> DataFrame:
    """One row a slot, without slots that show neither build, number nor trait. Gaps of a
    snapshot come from ``recovered_bio``, traits and attributes from the pool of its tag. A
    side has one captain, the first in the order of positions. platforms (match_id, side,
    who, platform; who is a player_id of ours or a plain tag of theirs, once each) outrank what was read."""
    people = playing(snapshots)
    rows = slot_snapshots(people).join(people.drop(*SLOT), "id")
    rows = rows.join(pooled_traits(people, traits), [*SIDE, "pool"], "left").join(pooled_attributes(people, attributes), [*SIDE, "pool"], "left")
    rows = rows.filter("build IS NOT NULL OR number IS NOT NULL OR traits IS NOT NULL").join(recovered_bio(views), ["match_id", "tag"], "left")
    blank = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    full = {f: F.coalesce(blank(f), f"seen_{f}") for f in BIO if f != "build_canonical"}
    rows = rows.withColumns(full | {"build_canonical": fuller_build(blank("build_canonical"), F.col("seen_build_canonical"))})
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, POSITIONS)), F.col("position")), F.lit(0).cast("long")), F.lit(99).cast("long"))
    rows = rows.withColumn("place", F.struct(place.alias("n"), "position"))
    first = F.min(F.when(F.col("is_captain"), F.col("place"))).over(Window.partitionBy(*SIDE))
    who = F.when(F.col("side") == "for", F.col("player_id").cast("string")).otherwise(F.col("tag"))
    rows = rows.withColumns({"is_captain": F.when(F.col("is_captain") & (F.col("place") != first), False).otherwise(F.col("is_captain")), "who": who})
    known = platforms.select(*SIDE, "who", F.col("platform").alias("known"))
    prestige, level = level_parts(F.col("level"))
    return rows.join(known, [*SIDE, "who"], "left").select(
        *SLOT, "id", "gamertag", "player_id", "build", "build_canonical", "number", "is_captain", "height", F.col("weight").cast("long").alias("weight"), "handedness",
        prestige.alias("prestige"), level.alias("level"), F.coalesce(F.nullif("known", F.lit("")), "platform").alias("platform"), "traits", "attributes",
    )
