"""Consensus over readings of a line-up, and verdicts on whole matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_tag

#: Scores from which a layer passes.
PASSES = {"events": 0.9, "lineup": 0.9, "completeness": 0.95, "truth": 0.95}


def anchors(snapshots: DataFrame, slot: list[str], fields: list[str], confidence: str) -> DataFrame:
    """slot and ``anchor``, the id of the snapshot that speaks for it. Those of source 'loadout' come
    first where there are any; among these, those whose gamertag (letters and digits) is the most
    frequent one of the slot (the smallest of ties); then the largest ``confidence`` if any has
    one, then the newest (largest id), as older rows may hold values that were filled in later. Only
    where none has the frequent tag and none a confidence, the one with most ``fields`` read, the
    oldest of ties."""
    tag = plain_tag(F.col("gamertag"))
    tags = snapshots.filter(tag != "").groupBy(*slot, tag.alias("_tag")).agg(F.count("*").alias("_n"))
    usual = tags.groupBy(*slot).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_tag")).alias("_u")).select(*slot, F.col("_u._tag").alias("_usual"))
    rows = snapshots.join(usual, slot, "left")
    matching, conf = F.coalesce(tag == F.col("_usual"), F.lit(False)), F.col(confidence).cast("double")
    read = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    newest = matching | conf.isNotNull()
    order = F.struct((F.col("source") == "loadout").alias("p"), matching.alias("m"), F.coalesce(conf, F.lit(-1.0)).alias("c"), F.when(newest, 0).otherwise(read).alias("n"), F.when(newest, F.col("id")).otherwise(-F.col("id")).alias("i"), "id")
    return rows.groupBy(*slot).agg(F.max(order).alias("b")).select(*slot, F.col("b.id").alias("anchor"))


def lineup_consensus(snapshots: DataFrame, slot: list[str], fields: list[str], preferred: list[str], confidence: str) -> DataFrame:
    """One row a slot: its anchor and each field's value of the largest summed confidence
    (none: 1), the anchor's on ties, then that of the smallest id. For ``preferred`` fields
    only snapshots of source 'loadout' vote where any of them has a value. Votes are summed
    by value before a window ranks them. Snapshots: slot, id, source, fields, conf_<field>."""
    found = anchors(snapshots, slot, fields, confidence)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.coalesce(F.col(f"conf_{f}").cast("decimal(18,4)"), F.lit(1).cast("decimal(18,4)")).alias("weight")) for f in fields])
    rows = snapshots.join(found, slot).select(*slot, "id", "anchor", "source", F.inline(cells)).filter("value IS NOT NULL")
    seen = F.when(F.col("id") == F.col("anchor"), F.lit(-1)).otherwise(F.col("id"))
    votes = rows.groupBy(*slot, "field", "value", (F.col("source") == "loadout").alias("first_hand")).agg(F.sum("weight").alias("weight"), F.min(seen).alias("seen"))
    one = Window.partitionBy(*slot, "field")
    votes = votes.withColumn("any", F.bool_or("first_hand").over(one)).filter(~F.col("field").isin(preferred) | ~F.col("any") | F.col("first_hand"))
    votes = votes.groupBy(*slot, "field", "value").agg(F.sum("weight").alias("weight"), F.min("seen").alias("seen"))
    best = votes.groupBy(*slot, "field").agg(F.max_by("value", F.struct("weight", -F.col("seen"))).alias("value"))
    wide = best.groupBy(*slot).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return found.join(wide, slot, "left")


def single_captains(rows: DataFrame, side: list[str], score: str, ident: str, least: float) -> DataFrame:
    """``rows`` with is_captain: the row of the largest score of its side that reaches
    ``least`` (smallest id on ties); false for all where none does."""
    order = Window.partitionBy(*side).orderBy(F.desc_nulls_last(score), F.asc(ident))
    first = (F.row_number().over(order) == 1) & F.coalesce(F.col(score) >= least, F.lit(False))
    return rows.withColumn("is_captain", first)


def goals_verdict(bound: Column, coverage: Column, accuracy: Column, beyond: Column, vacuous: Column, forced: Column) -> Column:
    """Whether period goals may be promoted, the first reason in order."""
    return (
        F.when(bound.isNull() | (bound < 1), "not_applicable").when(coverage.isNull(), "not_applicable").when(coverage < 1, "review")
        .when(accuracy.isNull(), "not_applicable").when(accuracy != 1, "review").when(F.coalesce(beyond, F.lit(0)) > 0, "review")
        .when(F.coalesce(vacuous, F.lit(False)) & ~F.coalesce(forced, F.lit(False)), "review").otherwise("reconciled")
    )


def faceoffs_verdict(bound: Column, coverage: Column, truth: Column, accuracy: Column, contested: Column) -> Column:
    """promote, or the first thing that is missing."""
    return (
        F.when(bound.isNull() | (bound < 1), "no bound").when(coverage.isNull(), "no readings").when(coverage < 1, "coverage").when(~F.coalesce(truth, F.lit(False)), "no truth")
        .when(accuracy.isNull(), "not gradable").when(accuracy != 1, "accuracy").when(~F.coalesce(contested, F.lit(False)), "uncontested").otherwise("promote")
    )


def family_promotion(family: Column, asked: Column, bound: Column, status: Column, verdict: Column, complete: Column) -> Column:
    """Outcome for a family of period rows: shots never, then the period asked for must be
    the bound, a rejected extraction outranks evidence, then verdict, then completeness."""
    return (
        F.when(family == "shots", "rejected: shots").when(~asked.eqNullSafe(bound), "rejected: bound").when(status == "rejected", "rejected: extraction")
        .when(~verdict.isin("reconciled", "promote"), "held: verdict").when(~complete, "held: incomplete").otherwise("promoted")
    )


def final_gate(final_accuracy: Column, gradable: Column) -> Column:
    return F.when(final_accuracy == 1, "PASS").when(final_accuracy.isNotNull(), "HOLD").when(~gradable, "OPERATOR_CONFIRM").otherwise("HOLD")


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.greatest(F.lit(0.0), part.cast("double") / whole)).otherwise(F.lit(0.0))


def match_layers(events: DataFrame, deductions: DataFrame, slots: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """key, layer, score and passed for the layers of every match.

    events (key, side, actor_id): share of our events with an actor, less the rows deducted
    (key, n); slots (key, fields: array): share of filled fields; tables (key, actual,
    expected, weight): weighted completeness, where nothing expected does not count."""
    e = events.groupBy(key).agg(F.count_if(F.col("side") == "for").alias("n"), F.count_if((F.col("side") == "for") & F.col("actor_id").isNotNull()).alias("ok"))
    d = deductions.groupBy(key).agg(F.sum("n").alias("off"))
    filled = F.size(F.filter("fields", lambda x: x.isNotNull() & (x != "")))
    s = slots.groupBy(key).agg(F.sum(filled).alias("filled"), F.sum(F.size("fields")).alias("fields"))
    used = tables.filter("expected > 0 AND weight > 0")
    part = F.least(F.lit(1.0), F.col("actual").cast("double") / F.col("expected"))
    t = used.groupBy(key).agg(F.sum(part * F.col("weight")).alias("got"), F.sum("weight").alias("all"))
    rows = e.join(d, key, "left").join(s, key, "full").join(t, key, "full")
    scores = {"events": share(F.coalesce("ok", F.lit(0)) - F.coalesce("off", F.lit(0)), F.col("n")), "lineup": share(F.col("filled"), F.col("fields")), "completeness": share(F.col("got"), F.col("all"))}
    return rows.select(key, F.inline(F.array(*[F.struct(F.lit(k).alias("layer"), v.alias("score"), (v >= PASSES[k]).alias("passed")) for k, v in scores.items()])))
