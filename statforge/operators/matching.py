"""One-to-one assignment by descending score, in rounds of locally best pairs.

A pair that is the best left for both its sides is taken by the greedy order too, whatever else
the bucket holds, so every round takes all such pairs at once, by aggregates and joins on the
members, and drops what they used. Each round takes at least the best pair of every bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def greedy_pairs(scores: list[tuple[float, int, int]]) -> list[tuple[int, int, float]]:
    """One-to-one pairs of one bucket taken by descending score, then by ids."""
    left, right, out = set(), set(), []
    for s, a, b in sorted(scores, key=lambda x: (-x[0], x[1], x[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return out


def _mutual(pairs: DataFrame, bucket: str) -> DataFrame:
    """Pairs (bucket, a, b, score) that are the best both of a and of b."""
    order = F.struct((-F.col("score")).alias("s"), "a", "b")
    of_a = pairs.groupBy(bucket, "a").agg(F.min(order).alias("x")).select(bucket, "a", F.col("x.b").alias("b"), (-F.col("x.s")).alias("score"))
    of_b = pairs.groupBy(bucket, "b").agg(F.min(order).alias("x")).select(bucket, F.col("x.a").alias("a"), "b")
    return of_a.join(of_b, [bucket, "a", "b"])


def greedy_assignment(df: DataFrame, bucket: str) -> DataFrame:
    """bucket, a, b, score of the pairs taken from candidates (bucket, a, b, score); candidates
    with a null in any column are none."""
    left = kept(df.select(bucket, "a", "b", F.col("score").cast("double").alias("score")).dropna(), "candidates")
    taken = found = kept(_mutual(left, bucket), "assigned")
    while not found.isEmpty():
        left = kept(left.join(found, [bucket, "a"], "left_anti").join(found, [bucket, "b"], "left_anti"), "candidates")
        found = kept(_mutual(left, bucket), "assigned")
        taken = taken.unionByName(found)
    return taken


def _neighbours(points: DataFrame, bucket: str) -> DataFrame:
    """(bucket, a, b, score) of each point with the nearest values of the other side below and
    above it, the smaller id of ties. Equal values are met once, by either side."""
    near = []
    for way, first in ((F.asc("value"), F.desc("is_b")), (F.desc("value"), F.asc("is_b"))):
        before = Window.partitionBy(bucket).orderBy(way, first, F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
        last = lambda c: F.last(F.when(c, F.struct("id", "value")), ignorenulls=True).over(before)  # noqa: E731, B023
        near.append(F.when(F.col("is_b"), last(~F.col("is_b"))).otherwise(last(F.col("is_b"))))
    rows = points.select(bucket, "id", "value", "is_b", near[0].alias("low"), near[1].alias("high"))
    rows = rows.select(bucket, "id", "value", "is_b", F.explode(F.array("low", "high")).alias("x")).filter(F.col("x").isNotNull())
    own = lambda c: F.when(c, F.col("x.id")).otherwise(F.col("id"))
    return rows.select(bucket, own(F.col("is_b")).alias("a"), own(~F.col("is_b")).alias("b"), (-F.abs(F.col("value") - F.col("x.value"))).alias("score"))


def nearest_assignment(left: DataFrame, right: DataFrame, bucket: str) -> DataFrame:
    """Greedy assignment by nearness of ``value`` without a table of all pairs: bucket, a, b and
    score (minus the distance) from (bucket, id, value) on either side. Each round looks only at
    the neighbours of each point in the order of values; a bucket's order is one sort."""
    side = lambda x, is_b: x.select(bucket, "id", F.col("value").cast("double").alias("value"), F.lit(is_b).alias("is_b")).dropna()
    points, taken = kept(side(left, False).unionByName(side(right, True)), "points"), None
    while True:
        rest = points
        if taken is not None:
            used = taken.select(bucket, F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("is_b")), F.struct(F.col("b").alias("id"), F.lit(True).alias("is_b")))).alias("x")).select(bucket, "x.*")
            rest = points.join(used, [bucket, "id", "is_b"], "left_anti")
        found = kept(_mutual(_neighbours(rest, bucket), bucket), "assigned")
        if taken is not None and found.isEmpty():
            return taken
        taken = found if taken is None else taken.unionByName(found)
