"""Aggregations that are more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_value(votes: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """One row a group: the first by ``order``. Votes are expected pre-aggregated, one row
    per group and value, so a window sees values rather than votes."""
    w = Window.partitionBy(*group).orderBy(*order)
    return votes.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_seen_mode(df: DataFrame, group: list[str], value: str, ord_col: str) -> DataFrame:
    """Most frequent non-null value, the first seen on ties: group, value, votes."""
    votes = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("votes"), F.min(ord_col).alias("_seen"))
    return top_value(votes, group, value, [F.desc("votes"), F.asc("_seen")]).drop("_seen")


def weighted_mode(df: DataFrame, group: list[str], value: str, weight: Column, ord_col: str) -> DataFrame:
    """Value of the largest summed weight (null or NaN weighs 1), first seen on ties."""
    w = F.coalesce(F.nanvl(weight.cast("double"), F.lit(1.0)), F.lit(1.0)).cast("decimal(18,2)")
    votes = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(w).alias("weight"), F.min(ord_col).alias("_seen"))
    return top_value(votes, group, value, [F.desc("weight"), F.asc("_seen")]).drop("_seen")


def rollup_modes(df: DataFrame, group: str, mode: str, *aggs: Column) -> DataFrame:
    """Rows for each mode and for all modes; ``is_total`` tells a total from a null mode."""
    return df.groupingSets([[F.col(group)], [F.col(group), F.col(mode)]], group, mode).agg(*aggs, F.grouping(mode).cast("int").alias("is_total"))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group and the value at place n // 2 (from 0) of its sorted values, not interpolated.
    Places come from windows, which spill, so a large group is no array."""
    w = Window.partitionBy(*group)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    return rows.filter("_r = _n DIV 2 + 1").drop("_r", "_n")


def element_sums(df: DataFrame, group: str, array: str, width: int, scale: int) -> DataFrame:
    """Element-wise decimal sums: one sum for each position, combined before the shuffle."""
    sums = [F.sum(F.get(F.col(array), F.lit(i)).cast(f"decimal(18,{scale})")).alias(f"e{i}") for i in range(width)]
    return df.groupBy(group).agg(*sums, F.count("*").alias("n"))


def member_means(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Mean of a pair measure for each member; every pair counts for both."""
    return pairs.select(F.explode(F.array(a, b)).alias("member"), value).groupBy("member").agg(F.avg(value).alias("mean"), F.count("*").alias("pairs"))
