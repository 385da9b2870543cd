"""Joins: pairs, with/without, division, bands, neighbours in time, fuzzy resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams, one_letter_keys, snapshot_name

#: The steps of ``resolve_cascade``, in order.
VIA = ["gamertag_exact", "gamertag_history_exact", "display_alias_exact", "gamertag_substring", "gamertag_levenshtein", "unresolved"]


def unordered_pairs(df: DataFrame, group: str, member: str, keep: list[str]) -> DataFrame:
    """Pairs a < b of distinct members of a group. Quadratic in a group's members, which a
    line-up bounds."""
    left = df.select(group, F.col(member).alias("a"), *keep)
    right = df.select(group, F.col(member).alias("b"))
    return left.join(right, group).filter("a < b")


def with_without(facts: DataFrame, units: DataFrame, member: str, unit: str, measures: list[str]) -> DataFrame:
    """Sums over the units a member took part in, and over all others: the total of all
    units less the member's own, so no cross join of members and units is needed."""
    total = units.agg(*[F.sum(m).alias(f"all_{m}") for m in measures])
    own = facts.select(member, unit).distinct().join(units, unit).groupBy(member).agg(*[F.sum(m).alias(f"with_{m}") for m in measures])
    rows = own.join(F.broadcast(total))  # one row
    return rows.select(member, *[f"with_{m}" for m in measures], *[(F.col(f"all_{m}") - F.col(f"with_{m}")).alias(f"without_{m}") for m in measures])


def units_with_all(df: DataFrame, unit: str, conditions: list[Column]) -> DataFrame:
    """Relational division: units in which each condition holds for some row."""
    flags = df.groupBy(unit).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"_c{i}") for i, c in enumerate(conditions)])
    return flags.filter(reduce(lambda a, b: a & b, [F.col(f"_c{i}") for i in range(len(conditions))])).select(unit)


def band_pairs(df: DataFrame, keys: list[str], x: str, ident: str, width: int) -> DataFrame:
    """Pairs a < b of rows with equal keys and |x - x'| <= width. Rows go to the bucket of
    their value, one side also to both neighbours, so the join is on equality."""
    cell = F.floor(F.col(x) / width)
    left = df.select(*keys, F.col(ident).alias("a"), F.col(x).alias("_xa"), cell.alias("_cell"))
    right = df.select(*keys, F.col(ident).alias("b"), F.col(x).alias("_xb"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    return left.join(right, [*keys, "_cell"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("_xa") - F.col("_xb")) <= width)).select(*keys, "a", "b")


def neighbours(df: DataFrame, group: list[str], ts: str, ident: str) -> DataFrame:
    """Ids of the nearest rows strictly before and after; ties in time are skipped, and of
    several nearest rows the smallest id is named."""
    steps = df.groupBy(*group, ts).agg(F.min(ident).alias("_id"))
    w = Window.partitionBy(*group).orderBy(ts)
    steps = steps.withColumns({"previous_id": F.lag("_id").over(w), "next_id": F.lead("_id").over(w)}).drop("_id")
    return df.join(steps, [*group, ts])


def within_one_edit(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose texts ``a`` and ``b`` are at most one edit apart: both sides meet
    on their one-letter deletions and are then compared. Merged, as the sizes of exploded keys are
    underestimated and either side would be broadcast."""
    met = left.withColumn("_key", F.explode(one_letter_keys(F.col(a)))).join(right.withColumn("_key", F.explode(one_letter_keys(F.col(b)))).hint("merge"), "_key").drop("_key")
    return met.filter(F.levenshtein(a, b) <= 1).distinct()


#: Texts up to this length are looked up as they are; longer ones by their rarest stretch of it.
GRAM = 3


def _rarest(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """Pairs (rows of both) where the whole contains the part, for parts of more than ``GRAM``
    letters: each part is looked for under that of its stretches which the fewest wholes have."""
    held = wholes.withColumn("_g", F.explode(grams(F.col(whole), GRAM)))
    often = held.groupBy("_g").agg(F.count("*").alias("_n"))
    long = parts.filter(F.length(part) > GRAM)
    asked = long.select(part, F.explode(grams(F.col(part), GRAM)).alias("_g")).join(often.hint("merge"), "_g", "left")
    asked = asked.groupBy(part).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("x")).filter("x.n > 0").select(part, F.col("x._g").alias("_g"))
    return long.join(asked.hint("merge"), part).join(held.hint("merge"), "_g").filter(F.contains(F.col(whole), F.col(part))).drop("_g")


def _short_grams(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("_g", F.explode(F.concat(*[grams(F.col(text), n) for n in range(1, GRAM + 1)])))


def names_in_tags(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, low and high: the least and greatest player among tags (tag, low, high) that contain
    the name. A short name meets one row, however many tags hold it."""
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    short = _short_grams(tags, "tag").groupBy(F.col("_g").alias("name")).agg(*ends).join(names.filter(F.length("name") <= GRAM).hint("merge"), "name", "left_semi")
    return short.unionByName(_rarest(names, "name", tags, "tag").groupBy("name").agg(*ends))


def tags_in_names(names: DataFrame, tags: DataFrame) -> DataFrame:
    """name, low and high of the tags that a name contains."""
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]
    short = _short_grams(names, "name").join(tags.filter(F.length("tag") <= GRAM).withColumnRenamed("tag", "_g").hint("merge"), "_g")
    return short.select("name", "low", "high").unionByName(_rarest(tags, "tag", names, "name").select("name", "low", "high")).groupBy("name").agg(*ends)


def resolve_cascade(probes: DataFrame, players: DataFrame, history: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, player_id and via of each probe (id, snapshot) by the first step that answers:
    equal gamertag, equal tag in use of the history, equal display alias, the only active
    gamertag that contains the snapshot or is contained in it, the only active gamertag one
    edit away; else unresolved. Of several equal names the smallest player_id answers.

    players (player_id, gamertag, is_active), history (player_id, gamertag, in_use) and
    aliases (player_id, alias). Every step is a join on equality over distinct names; as only one
    answer counts, the least and the greatest player of each name are kept, not all."""
    named = probes.select("id", F.lower(snapshot_name(F.col("snapshot"))).alias("name"))
    known = players.select(F.lower("gamertag").alias("name"), F.lit(1).alias("step"), "player_id")
    known = known.unionByName(history.filter("in_use").select(F.lower("gamertag").alias("name"), F.lit(2).alias("step"), "player_id"))
    known = known.unionByName(aliases.select(F.lower("alias").alias("name"), F.lit(3).alias("step"), "player_id"))
    known = known.filter("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.min(F.struct("step", "player_id")).alias("hit"))
    names = named.filter("name <> ''").select("name").distinct().join(known.hint("merge"), "name", "left_anti")
    tags = players.filter("is_active").select(F.lower("gamertag").alias("tag"), "player_id").filter("tag <> ''")
    tags = tags.groupBy("tag").agg(F.min("player_id").alias("low"), F.max("player_id").alias("high"))
    held = names_in_tags(names, tags).unionByName(tags_in_names(names, tags)).withColumn("step", F.lit(4))
    near = within_one_edit(names, tags, "name", "tag").select("name", "low", "high", F.lit(5).alias("step"))
    only = held.unionByName(near).groupBy("name", "step").agg(F.min("low").alias("player_id"), F.max("high").alias("_last")).filter("player_id = _last")
    only = only.groupBy("name").agg(F.min(F.struct("step", "player_id")).alias("hit"))
    found = named.join(known.unionByName(only).hint("merge"), "name", "left")
    via = F.element_at(F.array(*[F.lit(v) for v in VIA]), F.coalesce(F.col("hit.step"), F.lit(len(VIA))))
    return found.select("id", F.col("hit.player_id").alias("player_id"), via.alias("via"))


def resolve_persona(probes: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, canonical and via: an equal alias, else the smallest alias one edit away, else
    the cleaned snapshot itself; no row for snapshots that are empty after cleaning."""
    named = probes.select("id", snapshot_name(F.col("snapshot")).alias("cleaned")).filter("cleaned <> ''").withColumn("name", F.lower("cleaned"))
    known = aliases.select(F.lower("alias").alias("alias"), "canonical")
    met = within_one_edit(named.select("name").distinct(), known, "name", "alias")  # each name once, however many show it
    best = met.groupBy("name").agg(F.min(F.struct((F.col("name") != F.col("alias")).alias("far"), "alias", "canonical")).alias("b"))
    rows = named.join(best, "name", "left")
    via = F.when(F.col("b").isNull(), "raw").when(F.col("b.far"), "fuzzy_alias").otherwise("exact_alias")
    return rows.select("id", F.coalesce("b.canonical", "cleaned").alias("canonical"), via.alias("via"))


def lineup_gate(actors: DataFrame, lineup: DataFrame, unit: str, who: str) -> DataFrame:
    """``gate`` for each actor: ok, roster_mismatch, or empty_lineup_passthrough where the
    unit has no lineup at all."""
    known = lineup.filter(F.col(who).isNotNull()).select(unit, who, F.lit(True).alias("_in")).distinct()
    any_one = known.select(unit, F.lit(True).alias("_any")).distinct()
    rows = actors.join(any_one, unit, "left").join(known, [unit, who], "left")
    return rows.withColumn("gate", F.when(F.col("_any").isNull(), "empty_lineup_passthrough").when(F.col("_in").isNull(), "roster_mismatch").otherwise("ok")).drop("_any", "_in")


def bound_alone(left: DataFrame, right: DataFrame, bucket: str, a: str, b: str) -> DataFrame:
    """Pairs of buckets in which exactly one row is left on either side."""
    one = lambda rows, c: rows.groupBy(bucket).agg(F.max(c).alias(c), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return one(left, a).join(one(right, b), bucket)


def far_from(rows: DataFrame, others: DataFrame, keys: list[str], x: str, width: int) -> DataFrame:
    """Rows without any of ``others`` that has their keys and lies within ``width``. The
    others go to three buckets of values each, so the join is on equality."""
    cell = F.floor(F.col(x) / width)
    near = others.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(x).alias("_x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")).distinct()
    on = reduce(lambda c, d: c & d, [F.col(k) == F.col(f"_{k}") for k in keys], (cell == F.col("_cell")) & (F.abs(F.col(x) - F.col("_x")) <= width))
    return rows.join(near, on, "left_anti")
