"""Line-ups of three a side on their own ladder, by identity first and by the lobby's label after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_tag

# Places of the ladder by the position that a payload or a lobby of six names.
PLAYED = {"center": "C", "leftWing": "W", "rightWing": "W", "defenseMen": "D", "goalie": "G"}
LOBBY = {"C": "C", "LW": "W", "RW": "D"}
LADDER = ["C", "W", "D", "G"]
SIDE = ["match_id", "side"]


def named(places: dict[str, str], position: Column) -> Column:
    return reduce(lambda c, kv: F.when(position == kv[0], kv[1]).otherwise(c), places.items(), F.lit(None).cast("string"))


def rekeyed(rows: DataFrame, stats: DataFrame, detail: list[str], shared: Column) -> DataFrame:
    """``rows`` (match_id, side, id, position, player_id, gamertag, ``detail`` columns) where
    those of matches of three (``shared``) get the place of the ladder as their position, one row a place.

    A row belongs to the stat row (match_id, side, id, player_id, gamertag, position) of its
    player, for our side, else of its plain tag; of several the last by player, the first by
    tag. Its position gives the place and no other does. A row without a stat row takes the
    place that its lobby label names. Of rows of one place those with a stat row come first,
    then those with more ``detail`` that is not null, then the smaller id. Rows without a place
    are left out, and rows of other matches pass as they are."""
    first = lambda f, by: f(F.struct("position"), "id").alias(by)
    by_player = stats.filter("side = 'for' AND player_id IS NOT NULL").groupBy(*SIDE, "player_id").agg(first(F.max_by, "_own"))
    tagged = stats.withColumn("_tag", plain_tag(F.col("gamertag"))).filter("_tag <> ''").groupBy(*SIDE, "_tag").agg(first(F.min_by, "_named"))
    three = rows.filter(shared).withColumn("_tag", plain_tag(F.col("gamertag"))).join(by_player, [*SIDE, "player_id"], "left").join(tagged, [*SIDE, "_tag"], "left")
    stat = F.coalesce("_own", "_named")
    place = F.when(stat.isNotNull(), named(PLAYED, stat["position"])).otherwise(named(LOBBY, F.col("position")))
    known = sum((F.col(c).isNotNull().cast("int") for c in detail), F.lit(0))
    kept = three.withColumns({"_place": place, "_rank": F.struct(stat.isNotNull(), known, -F.col("id"))}).filter("_place IS NOT NULL")
    whole = F.struct(*[F.col("_place").alias("position") if c == "position" else F.col(c) for c in rows.columns])
    best = kept.groupBy(*SIDE, "_place").agg(F.max_by(whole, "_rank").alias("r")).select("r.*")
    return rows.filter(~F.coalesce(shared, F.lit(False))).unionByName(best)
