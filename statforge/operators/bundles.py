"""Which observations show one subject, and which events of a run are there already."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_letter_keys, plain_tag, snapshot_name
from ..sources.scratch import kept

#: Letters of a tag that are compared, the fewest for a comparison, and the most edits.
HEAD, SHORTEST, EDITS = 6, 3, 2


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v): the smallest node reachable. Each round
    hangs every node's neighbours on the smallest one, first the larger ones, then the others."""
    rows = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, sign(rows)
    while now != before:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = kept(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        top = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(top, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = kept(small.unionByName(top.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, sign(rows)
    ends = rows.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def same_subject_links(identities: DataFrame, group: str) -> DataFrame:
    """Pairs (u, v) of ids of one group that show the same subject: equal tags, or heads of at
    least three and up to six letters at most two edits apart, where at exactly two neither
    position nor jersey may differ. Equal tags form a star; others meet on the letters left when up
    to two are dropped, so no pairs of a group are made. Identities: id, group, tag, position, jersey."""
    star = identities.groupBy(group, "tag").agg(F.min("id").alias("v"))
    equal = identities.join(star.hint("merge"), [group, "tag"]).select(F.col("id").alias("u"), "v")
    length = F.least(F.length("tag"), F.lit(HEAD))
    heads = identities.filter(length >= SHORTEST).withColumn("_size", length).withColumn("_n", F.explode(F.sequence(F.lit(SHORTEST), length)))
    heads = heads.withColumn("_head", F.substr("tag", F.lit(1), F.col("_n")))
    # each distinct head is compared once; merged, as the sizes of exploded rows are underestimated and either side would be broadcast
    dropped = F.array_distinct(F.flatten(F.transform(one_letter_keys(F.col("_head")), one_letter_keys)))
    keyed = heads.select(group, "_n", "_head").distinct().withColumn("_key", F.explode(dropped))
    met = keyed.join(keyed.withColumnRenamed("_head", "_other").hint("merge"), [group, "_n", "_key"]).select(group, "_n", "_head", "_other").distinct()
    met = met.withColumn("_far", F.levenshtein("_head", "_other")).filter(F.col("_far") <= EDITS)
    one = heads.select(group, "_n", "_head", "id", "tag", "position", "jersey", "_size")
    two = one.withColumnsRenamed({"_head": "_other", "id": "_id", "tag": "_tag", "position": "_position", "jersey": "_jersey", "_size": "_their"})
    pairs = met.join(one.hint("merge"), [group, "_n", "_head"]).join(two.hint("merge"), [group, "_n", "_other"])
    pairs = pairs.filter((F.col("id") < F.col("_id")) & (F.col("tag") != F.col("_tag")) & (F.least("_size", "_their") == F.col("_n")))
    clash = F.coalesce(F.col("position") != F.col("_position"), F.lit(False)) | F.coalesce(F.col("jersey") != F.col("_jersey"), F.lit(False))
    near = pairs.filter((F.col("_far") < EDITS) | ~clash).select(F.col("id").alias("u"), F.col("_id").alias("v"))
    return equal.unionByName(near).distinct()


def subject_bundles(seen: DataFrame, group: str) -> DataFrame:
    """id and ``bundle`` (its smallest id) of each observation (id, group, gamertag, position, jersey): links
    are sought among distinct identities of a group and followed all the way. Observations
    whose tag has no letter or digit share the bundle of others without one."""
    named = seen.select("id", group, plain_tag(F.coalesce("gamertag", F.lit(""))).alias("tag"), "position", "jersey")
    keys = [group, "tag", "position", "jersey"]
    distinct = kept(named.groupBy(*keys).agg(F.min("id").alias("id")), "identities")
    found = connected(same_subject_links(distinct, group))
    of = distinct.withColumnRenamed("id", "_id").join(found.withColumnRenamed("node", "_id").hint("merge"), "_id", "left").select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("component", "_id").alias("bundle"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return named.join(of.hint("merge"), same[0] & same[1] & same[2] & same[3]).select("id", "bundle")


def merged_subjects(seen: DataFrame, bundles: DataFrame) -> DataFrame:
    """One row a bundle: the gamertag and jersey of the highest confidence and the position seen most
    often, then with the highest confidence (the smaller value or older row of ties), frames."""
    rows = seen.join(bundles, "id")
    best = lambda c, conf: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce(conf, F.lit(0.0)).alias("c"), (-F.col("id")).alias("i")))).alias(c)
    one = rows.groupBy("bundle").agg(best("gamertag", F.col("confidence")), best("jersey", F.col("confidence")), F.count("*").alias("frames"))
    votes = rows.filter("position IS NOT NULL").groupBy("bundle", "position").agg(F.count("*").alias("n"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    top = votes.groupBy("bundle").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("c")).alias("c"), "position")).alias("t")).select("bundle", F.col("t.position").alias("position"))
    return one.join(top, "bundle", "left")


class RunEvents:
    """Events of one bucket, found by actor or by names at most one edit apart."""

    def __init__(self):
        self.at: dict[int, tuple | None] = {}
        self.actors: dict[int, list[int]] = defaultdict(list)
        self.names: dict[str, list[tuple[str, int]]] = defaultdict(list)

    @staticmethod
    def keys(name: str) -> set[str]:
        return {name, *[name[:i] + name[i + 1 :] for i in range(len(name))]}

    @staticmethod
    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[i + (len(a) == len(b)) :] == b[i + 1 :]

    def add(self, ident: int, actor: int | None, name: str, spot: tuple | None) -> None:
        self.at[ident] = spot
        if actor is not None:
            self.actors[actor].append(ident)
        for k in self.keys(name) if name else ():
            self.names[k].append((name, ident))

    def find(self, actor: int | None, name: str, spot: tuple | None) -> list[int]:
        found = set(self.actors.get(actor, ())) if actor is not None else set()
        if not found and name:
            found = {i for k in self.keys(name) for n, i in self.names.get(k, ()) if self.near(n, name)}
        if spot is not None:
            found = {i for i in found if self.at[i] is None or self.at[i] == spot}
        return sorted(found)


def deduplicated_in_order(stored: DataFrame, incoming: DataFrame, bucket: list[str], order: str) -> DataFrame:
    """id, outcome and candidates of incoming events (id, bucket, order, actor_id, actor, x, y) against the
    stored ones (without order) and those that were inserted before them in the same run: hit
    (one candidate), insert (none) or ambiguous. Candidates have the actor's id or, if none has,
    a name at most one edit away; an event with a position leaves out those placed elsewhere, to
    the nearest whole unit. The events of a bucket stream through one task in order."""

    def prepared(df, is_new):
        spot = lambda c: F.floor(F.col(c) + 0.5).cast("long").alias(c)
        place = F.col(order).cast("long") if is_new else F.lit(None).cast("long")
        return df.select(F.xxhash64(*bucket).alias("_h"), F.struct(*bucket).alias("_b"), F.lit(is_new).alias("_new"), place.alias("_o"), F.col("id").cast("long").alias("id"), F.col("actor_id").cast("long").alias("actor_id"), F.lower(snapshot_name(F.coalesce("actor", F.lit("")))).alias("name"), spot("x"), spot("y"))

    def run(batches):
        last, events = object(), None
        for batch in batches:
            out = []
            for b, new, ident, actor, name, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != last:
                    last, events = b, RunEvents()
                spot = None if x is None or y is None else (x, y)
                found = events.find(actor, name, spot) if new else []
                if not found:
                    events.add(ident, actor, name, spot)
                if new:
                    out.append((ident, ("insert", "hit")[len(found)] if len(found) < 2 else "ambiguous", found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64())))], ["id", "outcome", "candidates"])

    rows = prepared(stored, False).unionByName(prepared(incoming, True)).repartition("_b").sortWithinPartitions("_b", "_new", "_o", "id")
    rows = rows.select(F.to_json("_b", {"ignoreNullFields": "false"}).alias("b"), "_new", "id", "actor_id", "name", "x", "y")
    return rows.mapInArrow(run, "id long, outcome string, candidates array<long>")
