"""Window operators. Every window is partitioned; ties are broken by an id or kept as peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(group: list[str], ts: str) -> Column:
    """Rows of the group up to this time; rows at one time share the highest number."""
    return F.count(F.lit(1)).over(Window.partitionBy(*group).orderBy(ts))


def before_average(group: list[str], ts: str, value: str) -> Column:
    """Mean of strictly earlier rows. ``ts`` must be a number or be cast to one."""
    w = Window.partitionBy(*group).orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    return F.sum(value).over(w).cast("double") / F.nullif(F.count(value).over(w), F.lit(0).cast("long"))


def minmax_score(value: Column, group: Window, invert: bool = False) -> Column:
    """0..100 within the group; 50 if all are equal, null with fewer than two values."""
    lo, hi = F.min(value).over(group), F.max(value).over(group)
    x = (value - lo).cast("double") / F.nullif(hi - lo, F.lit(0)).cast("double")
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - x if invert else x)))
    return F.when(F.count(value).over(group) >= 2, F.when(value.isNotNull(), F.coalesce(scaled, F.lit(50.0))))


def recent(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def streaks(df: DataFrame, group: list[str], order: list[Column], state: str) -> DataFrame:
    """Current state and how many newest rows share it."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumns({"_n": F.row_number().over(w), "_first": F.first(state).over(w)})
    return rows.groupBy(*group).agg(F.max("_first").alias("state"), (F.coalesce(F.min(F.when(F.col(state) != F.col("_first"), F.col("_n"))), F.count("*") + 1) - 1).alias("streak"))


def running_lead(df: DataFrame, group: list[str], order: str, side: Column) -> DataFrame:
    """Running score of two sides (side true: ours), lead before and after, and whether
    this row takes back a lead held before."""
    w = Window.partitionBy(*group).orderBy(order)
    out = df.withColumns({"ours": F.sum(side.cast("long")).over(w), "theirs": F.sum((~side).cast("long")).over(w)})
    out = out.withColumn("lead", F.signum((F.col("ours") - F.col("theirs")).cast("double")).cast("long"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"lead_before": F.coalesce(F.lag("lead").over(w), F.lit(0).cast("long")), "_led": F.bool_or(F.col("lead") > 0).over(past)})
    reclaims = (F.col("lead") > 0) & (F.col("lead_before") <= 0) & F.coalesce(F.col("_led"), F.lit(False))
    return out.withColumn("reclaims", reclaims).drop("_led")
