"""Evidence: parsing noisy values, voting, gates that promote a reading to a fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_letter_keys


def whole_number(c: Column) -> Column:
    """Missing or empty is 0; anything else must be a number, or the query fails."""
    n = F.trim(c).try_cast("long")
    bad = F.raise_error(F.concat(F.lit("expected a whole number, got: "), c)).cast("long")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(0).cast("long")).when(n.isNotNull(), n).otherwise(bad)


def whole_number_or_null(c: Column) -> Column:
    """The number a text starts with; null if there is none."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1), F.lit("")).cast("long")


def hex_channel(color: Column, i: int) -> Column:
    """Channel i (0: red) of '#rrggbb'."""
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("int")


def is_gray(color: Column, most: int = 16) -> Column:
    rgb = [hex_channel(color, i) for i in range(3)]
    return F.greatest(*rgb) - F.least(*rgb) <= most


def identity_key(ident: Column, tag: Column) -> Column:
    """One key for matched rows (by id) and unmatched ones (by lower-case tag)."""
    return F.coalesce(F.concat(F.lit("p:"), ident.cast("string")), F.concat(F.lit("g:"), F.lower(tag)))


def support(df: DataFrame, group: list[str], value: str, confidence: str) -> DataFrame:
    """Votes, summed and largest confidence of each candidate value."""
    return df.groupBy(*group, value).agg(F.count("*").alias("votes"), F.sum(confidence).alias("total"), F.max(confidence).alias("best"))


def promotion(candidates: DataFrame, group: list[str], value: str, trusted: float, ratio: float = 1.5) -> DataFrame:
    """The leading value of each group with a verdict, steps in order: unobserved (no
    value), invalid (fails the invariant column ``valid``), authority (best confidence is
    trusted), contested (not ``ratio`` times the next value), promoted."""
    w = Window.partitionBy(*group).orderBy(F.desc("votes"), F.desc("best"), F.asc_nulls_last(value))
    ranked = candidates.withColumns({"_r": F.row_number().over(w), "next_votes": F.lead("votes").over(w)}).filter("_r = 1").drop("_r")
    verdict = (
        F.when(F.col(value).isNull(), "unobserved")
        .when(~F.col("valid"), "invalid")
        .when(F.col("best") >= trusted, "authority")
        .when(F.col("next_votes").isNotNull() & (F.col("votes") < ratio * F.col("next_votes")), "contested")
        .otherwise("promoted")
    )
    return ranked.withColumn("verdict", verdict)


def first_valid(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each column the first non-null value in ascending order of ``order``."""
    place = F.struct(*order)
    return df.groupBy(*group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def clusters(df: DataFrame, group: list[str], x: str, gap: float) -> DataFrame:
    """Numbers rows by clusters of x: a new one starts where the step exceeds ``gap``."""
    w = Window.partitionBy(*group).orderBy(x)
    far = F.coalesce((F.col(x) - F.lag(x).over(w) > gap).cast("long"), F.lit(0).cast("long"))
    return df.withColumn("_far", far).withColumn("cluster", F.sum("_far").over(w)).drop("_far")


def grade(truth: DataFrame, guess: DataFrame, key: str, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """field, compared, matched and accuracy over rows both have; null on both sides matches."""
    t, g = truth.select(key, *[F.col(c).alias(f"t_{c}") for c in columns]), guess.select(key, *[F.col(c).alias(f"g_{c}") for c in columns])
    ok = lambda c: F.coalesce(F.abs(F.col(f"t_{c}") - F.col(f"g_{c}")) <= tolerance, F.col(f"t_{c}").eqNullSafe(F.col(f"g_{c}")))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), ok(c).alias("ok")) for c in columns])
    return t.join(g, key).select(F.inline(fields)).groupBy("field").agg(F.count("*").alias("compared"), F.count_if("ok").cast("long").alias("matched"))


def phantoms(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """phantom, canonical and kind of pairs in a bucket (rows: id, clock, placed) of which
    just one is placed and whose clocks differ by a lost first or last digit or by one edit.
    Rows meet on the digits, those with one end left out, and one-letter deletions."""
    digits = F.regexp_replace("clock", ":", "")
    ends = F.array(digits, F.expr("substr(regexp_replace(clock, ':', ''), 2)"), F.expr("left(regexp_replace(clock, ':', ''), length(clock) - 2)"))
    keys = F.array_distinct(F.concat(F.transform(ends, lambda x: F.concat(F.lit("d"), x)), F.transform(one_letter_keys(F.col("clock")), lambda x: F.concat(F.lit("c"), x))))
    keyed = rows.filter("clock IS NOT NULL AND clock <> ''").withColumns({"digits": digits, "_key": F.explode(keys)})
    a = keyed.filter("placed").select(*bucket, "_key", F.col("id").alias("canonical"), F.col("clock").alias("ca"), F.col("digits").alias("da"))
    b = keyed.filter("NOT placed").select(*bucket, "_key", F.col("id").alias("phantom"), F.col("clock").alias("cb"), F.col("digits").alias("db"))
    lost = (F.abs(F.length("da") - F.length("db")) == 1) & (F.contains("da", "db") | F.contains("db", "da"))
    met = a.join(b, [*bucket, "_key"]).withColumn("kind", F.when(lost, "substring").when(F.levenshtein("ca", "cb") <= 1, "levenshtein-1"))
    return met.filter("kind IS NOT NULL").select("phantom", "canonical", "kind").distinct()


def exactly_one_edit(a: Column, b: Column) -> Column:
    """Two-argument distance: the three-argument form gives -1 beyond its bound."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b) == 1)


def fuzzy_jaccard(a: Column, b: Column, most: int = 1) -> Column:
    """Share of the union where membership allows ``most`` edits."""
    both = F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.levenshtein(x, y) <= most)))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def opened_once(rows: DataFrame, parsed: Column) -> DataFrame:
    """``rows`` with ``p``, ``parsed`` bound by a generator, which no filter is moved below: else a
    filter on several parts of ``p`` would write and parse each payload again for every part."""
    return rows.select("*", F.inline(F.array(F.struct(parsed.alias("p")))))
