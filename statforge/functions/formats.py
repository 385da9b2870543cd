"""Formats and small formulas of the read models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def played_at(c: Column) -> Column:
    """A text of epoch seconds, or of milliseconds beyond 1e11, else an ISO time; else null."""
    n = c.try_cast("long")
    return F.when(n > 100_000_000_000, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(F.try_to_timestamp(c))


def hours_minutes(seconds: Column) -> Column:
    """'2h 5m', or '5m' below an hour."""
    s = seconds.cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def save_pct_text(saves: Column, shots: Column) -> Column:
    """'.917', '1.000'; null without shots."""
    p = F.round(saves.cast("decimal(20,0)") * 1000 / shots.cast("decimal(20,0)"), 0).cast("int")
    return F.when(shots > 0, F.when(p >= 1000, F.lit("1.000")).otherwise(F.concat(F.lit("."), F.lpad(p.cast("string"), 3, "0"))))


def gaussian(x: Column, sigma: float) -> Column:
    """exp(-z * z / 2) of z = x / sigma."""
    return F.exp(-F.pow(x / sigma, 2) / 2)


def blended(a: Column, b: Column, t: Column) -> Column:
    """'#rrggbb' at share t (clamped to 0..1) of the way from a to b, halves rounded up."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    part = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("double")
    mix = [F.floor(part(a, i) + (part(b, i) - part(a, i)) * t + 0.5).cast("int") for i in range(3)]
    return F.lower(F.format_string("#%02x%02x%02x", *mix))


def period_number(label: Column) -> Column:
    """Number of a period from a noisy label: '1st', '2ND PERIOD', 'OT', 'OT2', 'P3'."""
    c = F.upper(F.trim(label))
    overtime = F.regexp_extract(c, r"^O\.?T\.?\s*(\d*)$", 1)
    ordinal = F.regexp_extract(c, r"(?:^|[^0-9])([123])(?:ST|ND|RD|$|[^0-9])", 1)
    return F.when(c.rlike(r"^O\.?T"), 3 + F.coalesce(F.nullif(overtime, F.lit("")).cast("int"), F.lit(1))).when(ordinal != "", ordinal.cast("int"))


def body_weight(c: Column) -> Column:
    """Pounds from 140 to 275 that a text names, else null."""
    n = F.nullif(F.regexp_extract(c, r"(\d{2,3})", 1), F.lit("")).cast("int")
    return F.when(n.between(140, 275), n)


def handedness(c: Column) -> Column:
    """Left or Right where a text says so, else null."""
    t = F.lower(c)
    return F.when(t.contains("left"), "Left").when(t.contains("right"), "Right")


def height_text(c: Column) -> Column:
    """Feet and inches like 5'8\" of a text that still has its foot mark, else null."""
    feet, inches = (F.regexp_extract(c, r"(\d)\s*'\s*(\d{1,2})", i) for i in (1, 2))
    return F.when(feet != "", F.concat(feet, F.lit("'"), inches, F.lit('"')))


def level_parts(c: Column) -> tuple[Column, Column]:
    """Prestige and level of 'P2LVL41' or 'LVL 7' (no prestige), else nulls."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("long")
    both = r"(?i)P(\d+)\s*LVL\s*(\d+)"
    return part(both, 1), F.coalesce(part(both, 2), part(r"(?i)LVL\s*(\d+)", 1))


def fixed(c: Column) -> Column:
    """A double (below 2**32 in size) to two places, halves of the exact binary value away from zero,
    as decimal(20,2). Written as its text, 1.005 looks like a half and is below one."""
    x = F.abs(c.cast("double"))
    high = F.floor(x * 2**20) / 2**20
    # 200 * high and 200 * (x - high) are exact, so the comparison is
    reaches = lambda n: (200 * high - (2 * n - 1)) + 200 * (x - high) >= 0
    n = F.floor(x * 100 + 0.5)
    n = F.when(reaches(n + 1), n + 1).when(reaches(n), n).otherwise(n - 1)
    return (F.when(c < 0, -n).otherwise(n).cast("decimal(20,0)") / 100).cast("decimal(20,2)")
