"""Depth charts: forwards in four lines of three lanes, three defence pairs, five goalies.

members: team, player, games by lane (left_wing, center, right_wing, defense), skater_gp,
goalie_gp and favorite (a lane, 'goalie' or null). A slot that nobody can take gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of a lane, and what a role takes off in the first and the second pass.
LANES = ["left_wing", "center", "right_wing"]
GAME, BEST_LANE, SECOND_LANE, CENTER, FAVORITE = 100, 30, 10, 5, 600
FIRST_PASS = {"forward": 0, "hybrid": -200, "defense": -500, "goalie": -1000}
SECOND_PASS = {"forward": 0, "hybrid": 0, "defense": -1000, "goalie": -2000}
GOALIE_IN_DEFENSE = -2000
LINES, DEFENDERS, GOALIES = 4, 6, 5
SLOTS = LINES * len(LANES)


def role() -> Column:
    forward = sum((F.col(c) for c in LANES), F.lit(0))
    goalie = F.coalesce(F.col("favorite") == "goalie", F.lit(False)) | (F.col("goalie_gp") > F.col("skater_gp"))
    return F.when(goalie, "goalie").when(F.col("defense") > forward, "defense").when(F.col("defense") > 0, "hybrid").otherwise("forward")


def lane_scores(members: DataFrame) -> DataFrame:
    """A row for each member and lane with the scores of both passes. Of lanes with equal
    games the one further left is the better."""
    games = F.array(*[F.struct((-F.col(c)).alias("n"), F.lit(i).alias("lane")) for i, c in enumerate(LANES)])
    order = F.transform(F.array_sort(games), lambda g: g["lane"])
    taken = lambda points: F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), F.col("role"))
    fit = lambda i, c: (
        F.col(c) * GAME + F.when(F.col("order")[0] == i, BEST_LANE).when(F.col("order")[1] == i, SECOND_LANE).otherwise(0)
        + (CENTER if c == "center" else 0) + F.when(F.col("favorite") == c, FAVORITE).otherwise(0)
    )
    lanes = F.array(*[F.struct(F.lit(i).alias("lane"), fit(i, c).cast("long").alias("fit")) for i, c in enumerate(LANES)])
    rows = members.withColumns({"role": role(), "order": order}).select("team", "player", "skater_gp", "role", F.inline(lanes))
    return rows.withColumns({"first": F.col("fit") + taken(FIRST_PASS), "second": F.col("fit") + taken(SECOND_PASS)})


def candidates(scores: DataFrame) -> DataFrame:
    """team, size and ``pool``: the members that can be picked at all. A pick passes over fewer
    than ``SLOTS`` others, so the first ``SLOTS`` of each lane and pass are enough, whatever the size of a team."""
    passes = F.array(*[F.struct(F.lit(p).alias("turn"), F.col(c).alias("score")) for p, c in ((1, "first"), (2, "second"))])
    rank = Window.partitionBy("team", "lane", "turn").orderBy(F.desc("score"), F.desc("skater_gp"), "player")
    rows = scores.select("team", "player", "skater_gp", "role", "lane", F.inline(passes)).withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= SLOTS)
    size = scores.filter("lane = 0").groupBy("team").agg(F.count("*").alias("size"))
    entry = F.struct("lane", "turn", "score", "skater_gp", (-F.col("player")).alias("back"), F.col("role").isin("defense", "goalie").alias("misfit"))
    return rows.groupBy("team").agg(F.collect_list(entry).alias("pool")).join(size, "team")


def forwards(members: DataFrame) -> DataFrame:
    """team, line, lane, player, is_depth. First every member once, line by line; slots that
    are left are filled lane by lane, each member once more at most. The higher score wins,
    then more games as a skater, then the smaller player. Depth is who stands on an earlier
    slot already or plays another role. A fold over twelve slots on a bounded pool."""
    turn = lambda i: F.when(i < F.col("size"), 1).otherwise(2)
    step = lambda i: F.when(i < F.col("size"), i).otherwise(SLOTS + i % 3 * LINES + F.floor(i / 3).cast("int"))
    slots = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.struct(step(i).alias("step"), i.alias("i"), turn(i).alias("turn"))))
    pick = "struct<i:int,turn:int,back:bigint,misfit:boolean>"

    def place(done: Column, slot: Column) -> Column:
        gone = F.transform(F.filter(done, lambda d: d["turn"] == slot["turn"]), lambda d: d["back"])
        free = F.filter("pool", lambda m: (m["lane"] == slot["i"] % 3) & (m["turn"] == slot["turn"]) & ~F.array_contains(gone, m["back"]))
        best = F.array_max(F.transform(free, lambda m: F.struct(m["score"], m["skater_gp"], m["back"], m["misfit"])))
        one = F.struct(slot["i"].alias("i"), slot["turn"].alias("turn"), best["back"].alias("back"), best["misfit"].alias("misfit"))
        return F.when(best.isNull(), done).otherwise(F.concat(done, F.array(one).cast(f"array<{pick}>")))

    chart = candidates(lane_scores(members)).select("team", F.inline(F.aggregate(slots, F.array().cast(f"array<{pick}>"), place)))
    again = F.row_number().over(Window.partitionBy("team", "back").orderBy("i")) > 1
    lane = F.get(F.array(*map(F.lit, LANES)), F.col("i") % 3)
    return chart.select("team", (F.floor(F.col("i") / 3) + 1).cast("int").alias("line"), lane.alias("lane"), (-F.col("back")).alias("player"), (again | F.col("misfit")).alias("is_depth"))


def ranked(rows: DataFrame, order: list[Column], most: int, lanes: list[str], depth: Column) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("team").orderBy(*order))
    rows = rows.withColumn("n", n).filter(F.col("n") <= most)
    line = (F.floor((F.col("n") - 1) / len(lanes)) + 1).cast("int")
    return rows.select("team", line.alias("line"), F.get(F.array(*map(F.lit, lanes)), (F.col("n") - 1) % len(lanes)).alias("lane"), "player", depth.alias("is_depth"))


def depth_charts(members: DataFrame) -> DataFrame:
    """team, line, lane, player and is_depth of forwards, defenders (those with games there
    first, by games, goalies last) and goalies (by games as such)."""
    rows = members.withColumn("role", role())
    score = F.col("defense") * GAME + F.when(F.col("role") == "goalie", GOALIE_IN_DEFENSE).otherwise(0)
    defense = ranked(rows, [F.desc(F.col("defense") > 0), F.desc(score), F.asc("player")], DEFENDERS, ["left_defense", "right_defense"], F.col("role") != "defense")
    goalies = ranked(rows.filter("goalie_gp > 0"), [F.desc("goalie_gp"), F.asc("player")], GOALIES, ["goalie"], F.col("role") != "goalie")
    return forwards(members).unionByName(defense).unionByName(goalies)
