"""Arithmetic with the null rules of the statistics tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "decimal(38,6)"


def ratio(num: Column, den: Column, times: int = 100, digits: int = 2) -> Column:
    """num / den * times, half away from zero on decimals; null unless den is positive."""
    return F.when(den > 0, F.round(num.cast(D) * times / den.cast(D), digits).cast("double"))


def rounded(number: Column, digits: int) -> Column:
    """A double times 10^digits rounded, halves away from zero, and divided again, as SQL engines do
    it; F.round takes the shortest decimal of the number instead. Keeps the sign of a zero."""
    times = float(10**digits)
    scaled = F.abs(number) * times
    return F.when(scaled < float("inf"), F.signum(number) * F.round(scaled) / times).otherwise(number)


def strict_sum(column: Column) -> Column:
    """Null as soon as any input is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def either_sum(a: Column, b: Column) -> Column:
    """a + b, a null counting as zero unless both are null."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def zero_as_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def weighted_mean(value: Column, weight: Column, digits: int = 4) -> Column:
    """Weights of null values do not count."""
    den = F.sum(F.when(value.isNotNull(), weight))
    return F.when(den > 0, F.round(F.sum(value.cast("decimal(18,6)") * weight).cast(D) / den, digits).cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("long")
