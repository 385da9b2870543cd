"""What readings of screens need: sides, drain decisions, missing rows, duplicates, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_letter_keys, plain_tag
from ..sources.scratch import kept
from .aggregates import upper_median
from .matching import greedy_assignment


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def away_side(was_home: Column, away: Column, home: Column, opponent: Column, ours: list[str]) -> Column:
    """'for' or 'against' for the away team (home is the other): by the flag if known, else
    by which one name is one of ``ours``, else by which one resembles the opponent's name;
    null if nothing tells."""
    known = F.array(*[F.lit(x) for x in ours])
    mine = lambda c: F.coalesce(F.array_contains(known, F.get(tokens(c), F.lit(0))) | F.array_contains(known, F.array_join(tokens(c), " ")), F.lit(False))
    like = lambda c: F.arrays_overlap(tokens(c), tokens(opponent))
    return (
        F.when(was_home, "against").when(~was_home, "for")
        .when(mine(away) & ~mine(home), "for").when(mine(home) & ~mine(away), "against")
        .when(like(away) & ~like(home), "against").when(like(home) & ~like(away), "for")
    )


#: Classes of flags that block an automatic drain.
BLOCKING = ["A", "B", "D", "G"]


def drain_decision(gates: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """drain, outcome, n_blocking and blocking (the classes, sorted) of each gate row (key,
    decision): only a PASS without failed flags of a blocking class is drained; ``outcome`` is
    drained, blocked (by flags) or not_passed."""
    bad = flags.filter((F.col("severity") == "fail") & F.col("class_id").isin(BLOCKING)).groupBy(key).agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("class_id")), "").alias("_bad"))
    rows = gates.join(bad, key, "left")
    n, passed = F.coalesce("_n", F.lit(0)), F.col("decision") == "PASS"
    outcome = F.when(~F.coalesce(passed, F.lit(False)), "not_passed").when(n > 0, "blocked").otherwise("drained")
    return rows.select(key, (outcome == "drained").alias("drain"), outcome.alias("outcome"), n.cast("long").alias("n_blocking"), F.coalesce("_bad", F.lit("")).alias("blocking"))


def recorded_at(files: DataFrame, name: str, zone: str) -> DataFrame:
    """``files`` with recorded_at (seconds since 1970; null for other names) of a local time in the
    file's name, and in_change: the time lies in the hour that a change of clocks in ``zone`` skips
    or repeats, so it is not sure."""
    local = F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd HH-mm-ss"))
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    # away from a change, an hour more or less by the clock is an hour more or less in time
    even = (F.to_utc_timestamp(local + hour, zone) == utc + hour) & (F.to_utc_timestamp(local - hour, zone) == utc - hour) & (F.from_utc_timestamp(utc, zone) == local)
    near = F.from_utc_timestamp(utc, zone) != local
    repeats = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return files.withColumns({"recorded_at": F.unix_timestamp(utc), "in_change": F.coalesce(~even & (near | repeats), F.lit(False))})


def density_radius(n: Column) -> Column:
    """Cluster radius in pixels: 15 up to 300 markers a period, falling in straight lines to
    10 at 1500 and 8 at 5000, then slowly to no less than 6."""
    n = n.cast("double")
    return F.when(n <= 300, 15.0).when(n <= 1500, 15 - 5 * (n - 300) / 1200).when(n <= 5000, 10 - 2 * (n - 1500) / 3500).otherwise(F.greatest(F.lit(6.0), 8 - (n - 5000) / 10000))


def filled_rows(seen: DataFrame, group: list[str], rows: int, default_gap: float, low: float, high: float) -> DataFrame:
    """group, row and y of rows 0 .. ``rows`` - 1: the y seen, or for missing rows that of
    the first row seen plus whole steps of the median gap; kept within low < y < high."""
    order = Window.partitionBy(*group).orderBy("y", "row")
    gaps = seen.withColumn("gap", F.col("y") - F.lag("y").over(order)).select(*group, "gap")
    base = seen.groupBy(*group).agg(F.min(F.struct("row", "y")).alias("_ref")).join(upper_median(gaps, group, "gap"), group, "left")
    every = base.select(*group, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), "_ref", F.coalesce("gap", F.lit(default_gap)).alias("_gap"))
    out = every.join(seen.select(*group, "row", F.col("y").alias("_y")), [*group, "row"], "left")
    y = F.coalesce("_y", F.col("_ref.y") + (F.col("row") - F.col("_ref.row")) * F.col("_gap"))
    return out.select(*group, "row", y.alias("y"), F.col("_y").isNull().alias("filled")).filter((F.col("y") > low) & (F.col("y") < high))


def existing_events(incoming: DataFrame, stored: DataFrame, bucket: list[str]) -> DataFrame:
    """id, existing and strategy of each incoming event that is stored already (both with id,
    actor_id, actor and bucket; stored with ``placed``): a placed row whose actor shares the
    first four letters, else a row of the same actor_id, else one whose actor's name is at
    most one edit away. Of several the smallest id: stored rows are first grouped by key to it, so
    no pairs of rows are made, only of distinct names one edit apart."""
    a = incoming.select("id", *bucket, "actor_id", plain_tag(F.col("actor")).alias("tag"))
    b = stored.select(F.col("id").alias("existing"), *bucket, "actor_id", plain_tag(F.col("actor")).alias("tag"), "placed")
    head = lambda c: F.when(F.length(c) >= 4, F.substring(c, 1, 4))
    least = lambda rows, k: rows.filter(F.col(k).isNotNull()).groupBy(*bucket, k).agg(F.min("existing").alias("existing"))
    first = a.withColumn("_h", head("tag")).join(least(b.filter("placed").withColumn("_h", head("tag")), "_h"), [*bucket, "_h"]).select("id", "existing", F.lit(0).alias("s"))
    second = a.join(least(b, "actor_id"), [*bucket, "actor_id"]).select("id", "existing", F.lit(1).alias("s"))
    names = least(b.filter("tag <> ''"), "tag").withColumnRenamed("tag", "_tag")
    asked = a.filter("tag <> ''").select(*bucket, "tag").distinct()
    keyed = lambda rows, c: rows.withColumn("_k", F.explode(one_letter_keys(F.col(c))))
    near = keyed(asked, "tag").join(keyed(names, "_tag"), [*bucket, "_k"]).filter(F.levenshtein("tag", "_tag") <= 1).groupBy(*bucket, "tag").agg(F.min("existing").alias("existing"))
    third = a.join(near, [*bucket, "tag"]).select("id", "existing", F.lit(2).alias("s"))
    best = first.unionByName(second).unionByName(third).groupBy("id").agg(F.min(F.struct("s", "existing")).alias("b"))
    names = F.array(*[F.lit(x) for x in ("placed_prefix", "actor_id", "actor_name")])
    return best.select("id", F.col("b.existing").alias("existing"), F.element_at(names, F.col("b.s") + 1).alias("strategy"))


def without_junk(rows: DataFrame, bucket: list[str]) -> DataFrame:
    """Rows less the unplaced ones whose bucket has a placed row with the same first four
    letters of the actor."""
    head = F.when(F.length(plain_tag(F.col("actor"))) >= 4, F.substring(plain_tag(F.col("actor")), 1, 4))
    keyed = rows.withColumn("_head", head)
    placed = keyed.filter(F.col("placed") & F.col("_head").isNotNull()).select(*bucket, "_head", F.lit(False).alias("placed")).distinct()
    return keyed.join(placed, [*bucket, "_head", "placed"], "left_anti").select(*rows.columns)


#: Members a side up to which a group's pairs are made and taken in its row.
LINE_UP = 64


def _taken_in_row(t: DataFrame, p: DataFrame, group: str, most: int) -> DataFrame:
    """group, id and slot of each member of ``t`` (group, m: id and tag): the pairs of a group
    with ``p`` are sorted and taken within one row."""
    named = lambda x: x["id"].isNotNull() & (x["tag"] != "")
    rows = t.groupBy(group).agg(F.collect_list("m").alias("_t")).join(p.groupBy(group).agg(F.collect_list("m").alias("_p")).hint("merge"), group, "left")
    pair = lambda x, y: F.struct(F.levenshtein(x["tag"], y["tag"], most).alias("d"), x["id"].alias("a"), y["id"].alias("b"))
    pairs = F.flatten(F.transform(F.filter("_t", named), lambda x: F.transform(F.filter("_p", named), lambda y: pair(x, y))))
    rows = rows.select(group, "_t", F.sort_array(F.filter(pairs, lambda x: x["d"] >= 0)).alias("_pairs"))  # -1: more than ``most``
    used = lambda taken, x: F.exists(taken, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    taken = F.aggregate("_pairs", F.slice("_pairs", 1, 0), lambda taken, x: F.when(used(taken, x), taken).otherwise(F.concat(taken, F.array(x))))
    rows = rows.select(group, "_t", taken.alias("_taken"))
    slot = lambda x: F.get(F.filter("_taken", lambda y: y["a"] == x["id"]), F.lit(0))["b"]
    return rows.select(group, F.inline(F.transform("_t", lambda x: F.struct(x["id"].alias("id"), slot(x).alias("slot")))))


def _taken_in_rounds(t: DataFrame, p: DataFrame, group: str, most: int) -> DataFrame:
    """The same for groups of any size, by joins."""
    left, right = (x.filter("m.tag <> ''").select(group, F.col("m.id").alias(c), F.col("m.tag").alias(f"_{c}")) for x, c in ((t, "a"), (p, "b")))
    pairs = left.join(right, group).withColumn("score", -F.levenshtein("_a", "_b").cast("double")).filter(F.col("score") >= -most)
    found = greedy_assignment(pairs.select(group, "a", "b", "score"), group).select(F.col(group), F.col("a").alias("id"), F.col("b").alias("slot"))
    return t.select(group, F.col("m.id").alias("id")).join(found, [group, "id"], "left")


def aligned_subjects(truth: DataFrame, predicted: DataFrame, group: str, most: int = 3) -> DataFrame:
    """Slots matched to the true subjects of a group (group, id, gamertag) by the smallest
    edit distance up to ``most``, each once. A group is one line-up, so its pairs are made and
    taken in one row, and tables dealt by group are not dealt again; groups of more than
    ``LINE_UP`` members a side are joined instead. No group (null): no slot."""
    named = lambda x: x.select(group, F.struct("id", plain_tag(F.col("gamertag")).alias("tag")).alias("m"))
    t, p = (named(x.filter(F.col(group).isNotNull())) for x in (truth, predicted))
    many = lambda x: x.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > LINE_UP).select(group)
    crowded = kept(many(t).unionByName(many(p)).distinct(), "crowded")
    if crowded.isEmpty():
        out = _taken_in_row(t, p, group, most)
    else:
        few, large = ([x.join(crowded, group, how) for x in (t, p)] for how in ("left_anti", "left_semi"))
        out = _taken_in_row(*few, group, most).unionByName(_taken_in_rounds(*large, group, most))
    alone = truth.filter(F.col(group).isNull()).select(group, "id", F.lit(None).cast(predicted.schema["id"].dataType).alias("slot"))
    return out.unionByName(alone)
