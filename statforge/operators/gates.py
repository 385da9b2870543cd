"""The gate that promotes readings of a slot's fields, with the invariants behind it.

Candidates: match_id, slot, field, evidence_id, value and confidence (null: 0). Votes are
summed by value before anything ranks them, so a window sees the values of a field, not its readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineup_reads import NO_PLAYERS

FIELD = ["match_id", "slot", "field"]
#: Traits a slot must show, attributes it must show at least, and the numbers that players wear.
TRAITS, ATTRIBUTES, NUMBERS = 3, 20, (0, 99)


def leaders(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FIELD, value and confidence of the best reading (the smallest evidence_id of ties), the
    number of readings, and how many readings of another value reach the threshold
    (conflicts), with the best of these (next_best). A null value is a value of its own."""
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    rows = candidates.select(*FIELD, "value", "evidence_id", conf.alias("c"))
    values = rows.groupBy(*FIELD, "value").agg(F.count("*").alias("n"), F.max(F.struct("c", (-F.col("evidence_id")).alias("back"))).alias("best"), F.count_if(F.col("c") >= threshold).alias("strong"))
    group = Window.partitionBy(*FIELD)
    ranked = values.withColumns({
        "k": F.row_number().over(group.orderBy(F.desc("best"))), "readings": F.sum("n").over(group), "all_strong": F.sum("strong").over(group),
        "next": F.lead("best.c").over(group.orderBy(F.desc("best"))),
    })
    next_best = F.when(F.col("next") >= threshold, F.col("next"))
    return ranked.filter("k = 1").select(*FIELD, "value", F.col("best.c").alias("confidence"), "readings", (F.col("all_strong") - F.col("strong")).alias("conflicts"), next_best.alias("next_best"))


def violations(candidates: DataFrame, best: DataFrame, slots: DataFrame, builds: list[str], threshold: float = 0.5, attributes: int = ATTRIBUTES) -> DataFrame:
    """FIELD and the invariant that fails. Of the leading value: a number is whole and one
    that players wear, a build is known, a tag that is no player's needs another field
    (number, build, trait) of the slot above the threshold. Of all readings: exactly three
    usable traits and enough usable attributes (with a value and some confidence). Of slots (match_id, slot,
    team_side, is_captain): a side is known, and no side has two captains."""
    whole = F.col("value").try_cast("int")
    number = F.when(whole.isNull(), "not a number").when(~whole.between(*NUMBERS), "no such number")
    build = F.when(~F.coalesce(F.col("value").isin(builds), F.lit(False)), "unknown build")
    tag = F.lower(F.trim("value"))
    support = candidates.filter(F.col("field").isin("number", "build", "trait") & (F.col("confidence") >= threshold)).select("match_id", "slot", F.lit(True).alias("backed")).distinct()
    junk = F.when((F.coalesce(F.length(tag), F.lit(0)) <= 1) | tag.isin(NO_PLAYERS), "no player's tag")
    rows = best.join(support, ["match_id", "slot"], "left")
    single = F.when(F.col("field") == "number", number).when(F.col("field") == "build", build).when((F.col("field") == "gamertag") & F.col("backed").isNull(), junk)
    of_values = rows.select(*FIELD, single.alias("violation"))

    usable = F.count_if(F.col("value").isNotNull() & (F.col("confidence") > 0))
    blocks = candidates.filter(F.col("field").isin("trait", "attribute")).groupBy(*FIELD).agg(usable.alias("n"))
    short = F.when((F.col("field") == "trait") & (F.col("n") != TRAITS), F.concat(F.lit("traits: "), F.col("n").cast("string")))
    short = short.when((F.col("field") == "attribute") & (F.col("n") < attributes), F.concat(F.lit("attributes: "), F.col("n").cast("string")))
    of_blocks = blocks.select(*FIELD, short.alias("violation"))

    counted = slots.withColumn("captains", F.count_if(F.col("is_captain")).over(Window.partitionBy("match_id", "team_side")))
    several = F.when(F.col("team_side").isNotNull() & F.col("is_captain") & (F.col("captains") > 1), F.concat(F.lit("captains: "), F.col("captains").cast("string")))
    checks = F.array(F.struct(F.lit("team_side").alias("field"), F.when(F.col("team_side").isNull(), "no side").alias("violation")), F.struct(F.lit("is_captain").alias("field"), several.alias("violation")))
    of_slots = counted.select("match_id", "slot", F.inline(checks))
    return of_values.unionByName(of_blocks).unionByName(of_slots).filter("violation IS NOT NULL")


def gated(expected: DataFrame, best: DataFrame, failed: DataFrame, authority: DataFrame, ratio: float = 1.5) -> DataFrame:
    """A decision for each field of ``expected`` (FIELD). In order: nothing read; an invariant
    of the field fails; an authority (FIELD, known, one row a field) knows another value;
    the leader is not ``ratio`` times the next value; promoted, with value and confidence."""
    first = failed.groupBy(*FIELD).agg(F.min("violation").alias("violation"))
    rows = expected.join(best, FIELD, "left").join(first, FIELD, "left").join(authority.select(*FIELD, "known"), FIELD, "left")
    close = F.col("next_best").isNotNull() & (F.col("confidence") / F.greatest(F.col("next_best"), F.lit(1e-9)) < ratio)
    status = (
        F.when(F.col("readings").isNull(), "unobserved").when(F.col("violation").isNotNull(), "invalid")
        .when(F.col("known").isNotNull() & ~F.col("known").eqNullSafe(F.col("value")), "overruled").when(close, "contested").otherwise("promoted")
    )
    rows = rows.withColumn("status", status)
    won = lambda c: F.when(F.col("status") == "promoted", F.col(c)).alias(c)
    counted = F.when(F.col("status").isin("unobserved", "invalid"), 0).otherwise(F.col("conflicts")).cast("long")
    return rows.select(*FIELD, "status", F.when(F.col("status") == "invalid", F.col("violation")).alias("violation"), won("value"), won("confidence"), F.coalesce("readings", F.lit(0)).cast("long").alias("readings"), counted.alias("conflicts"))
