"""Game clocks, durations and epochs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(c: Column) -> Column:
    """Digits commonly misread as letters."""
    return F.regexp_replace(F.translate(c, "OoDBIl", "000811"), "[^0-9:]", "")


def seconds_of(c: Column) -> Column:
    """MM:SS as seconds; null if malformed."""
    return F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int")


def mm_ss(s: Column) -> Column:
    s = s.cast("int")
    return F.concat(F.lpad((s / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def elapsed(remaining: Column, period: int = 1200) -> Column:
    """Time since the start of a period that counts down; null outside 00:00-20:00."""
    s = seconds_of(remaining)
    return F.when((s >= 0) & (s <= period) & (F.split_part(remaining, F.lit(":"), F.lit(2)).try_cast("int") < 60), F.lit(period) - s)


def from_epoch(x: Column) -> Column:
    """Seconds, or milliseconds beyond 1e11."""
    return F.when(x > 100_000_000_000, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def epoch_seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("long")
