"""Quality flags of matches: repeated, unresolved, colliding, missing and foreign events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts above which a flag fails, and the distance at which two markers are one.
MOST = {"repeated": 5, "unresolved": 5, "collisions": 3}
NEAR = 1


def collisions(events: DataFrame) -> DataFrame:
    """match_id and n, the number of pairs of a period whose markers lie within ``NEAR`` in x
    and y. Pairs are counted, not made: events meet as distinct points in cells of that
    width, and events of one point are counted by their number."""
    points = events.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("match_id", "period", "x", "y").agg(F.count("*").alias("n"))
    points = points.withColumns({"cx": F.floor(F.col("x") / NEAR), "cy": F.floor(F.col("y") / NEAR)})
    same = points.filter("n > 1").select("match_id", F.expr("n * (n - 1) DIV 2").alias("n"))
    around = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"))))
    a = points.select("match_id", "period", F.struct("x", "y").alias("a"), F.col("n").alias("na"), F.inline(F.flatten(around)))
    b = points.select("match_id", "period", F.struct("x", "y").alias("b"), F.col("n").alias("nb"), "cx", "cy")
    near = lambda c: F.abs(F.col("a")[c] - F.col("b")[c]) <= NEAR
    met = a.join(b, ["match_id", "period", "cx", "cy"]).filter((F.col("a") < F.col("b")) & near("x") & near("y"))
    return same.unionByName(met.select("match_id", (F.col("na") * F.col("nb")).alias("n"))).groupBy("match_id").agg(F.sum("n").alias("n"))


def outsiders(events: DataFrame, lineup: DataFrame, who: str) -> DataFrame:
    """match_id and n, events whose ``who`` is not in the match's line-up (match_id, player_id)."""
    seen = events.filter(F.col(who).isNotNull()).groupBy("match_id", F.col(who).alias("player_id")).agg(F.count("*").alias("n"))
    return seen.join(lineup.select("match_id", "player_id").distinct(), ["match_id", "player_id"], "left_anti").groupBy("match_id").agg(F.sum("n").alias("n"))


def quality_flags(events: DataFrame, matches: DataFrame, recorded: DataFrame, lineup: DataFrame) -> DataFrame:
    """match_id, flag, rule, n and severity (warn, fail), for matches where something is wrong.

    events: match_id, period, clock, kind, side, actor_tag, actor_id, target_id, x, y (decimals).
    A repeated: events of equal period, clock and kind beyond the first. B unresolved: ours
    with a tag but no actor; B unread: no tag, faceoffs aside. C collisions. D penalties:
    matches (match_id, pim) have minutes but no penalty event, a fault only where the events'
    screen was recorded (match_id). G actor and target: not in the line-up."""
    one = events.groupBy("match_id", "period", "clock", "kind").agg(
        F.count("*").alias("n"), F.count_if((F.col("side") == "for") & F.col("actor_tag").isNotNull() & F.col("actor_id").isNull()).alias("unresolved"),
        F.count_if(F.col("actor_tag").isNull() & (F.col("kind") != "faceoff")).alias("unread"),
    )
    by_match = one.groupBy("match_id").agg(
        F.sum(F.when(F.col("clock").isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated"), F.sum("unresolved").alias("unresolved"), F.sum("unread").alias("unread"),
        F.sum(F.when(F.col("kind") == "penalty", F.col("n")).otherwise(0)).alias("penalties"),
    )
    over = lambda rule: F.when(F.col("n") > MOST[rule], "fail").otherwise("warn")
    flag = lambda rows, letter, rule, severity: rows.filter("n > 0").select("match_id", F.lit(letter).alias("flag"), F.lit(rule).alias("rule"), F.col("n").cast("long").alias("n"), severity.alias("severity"))
    fail: Column = F.lit("fail")
    counts = {"repeated": ("A", F.col("repeated"), MOST["repeated"]), "unresolved": ("B", F.col("unresolved"), MOST["unresolved"]), "unread": ("B", F.col("unread"), None)}
    cells = [F.struct(F.lit(letter).alias("flag"), F.lit(rule).alias("rule"), c.cast("long").alias("n"), (F.when(c > most, "fail").otherwise("warn") if most is not None else F.lit("warn")).alias("severity")) for rule, (letter, c, most) in counts.items()]
    counted = by_match.select("match_id", F.inline(F.array(*cells))).filter("n > 0")
    had = by_match.filter("penalties > 0").select("match_id")
    missing = matches.select("match_id", F.col("pim").alias("n")).join(had, "match_id", "left_anti").join(recorded.select("match_id", F.lit(True).alias("seen")).distinct(), "match_id", "left")
    rest = [
        flag(collisions(events), "C", "collisions", over("collisions")), flag(missing, "D", "penalties", F.when(F.col("seen"), "fail").otherwise("warn")),
        flag(outsiders(events, lineup, "actor_id"), "G", "actor", fail), flag(outsiders(events, lineup, "target_id"), "G", "target", fail),
    ]
    return reduce(lambda a, b: a.unionByName(b), rest, counted)
