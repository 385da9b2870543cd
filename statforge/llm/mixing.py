"""Operator 6: mixing sources by temperature, in DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent, normalised. The
exponent is found by bisection: for a repetition limit, the smallest at which no source
is repeated more often than the limit relative to the least repeated one; for a target
entropy (nats), the one at which the weights have it. With both, the larger holds. The
budget defaults to the least at which every document is used; a given budget may leave
documents out. A source's quota is spent as whole epochs, and a last part of an epoch is
the start of a block permutation: documents are dealt into blocks and ordered in them by a
hash of document and epoch, and a cut in that order spends the rest of the quota.

Only (source, block) totals and the rows of the block with the cut are summed in order, so
a source on most rows is many blocks, and documents themselves are never shuffled. Sources
are a table too: only sums over them stand in one row.

Nulls: a null source is a source of its own; a null text has no tokens; sources without
tokens keep their documents once; a null doc_id hashes as empty. Repeated rows fall on the
same side of the cut, and documents with equal hashes (ties) too. A very long text counts
whole. An empty table gives no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, staged, table, unpacked
from .quality_rules import SPACES

ROUNDS = 60
WAYS, ENTROPY_ROUNDS = 16, 15
BLOCK_ROWS = 1024
MOST_BROADCAST = 100_000
REPETITION = 1.5


def n_words(column: str) -> Column:
    core = F.btrim(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+"))).cast("long")


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))


def order_hash(epoch: Column) -> Column:
    """Place of a document in an epoch's permutation, 60 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), epoch.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def repetition_exponent(top: Column, low: Column, limit: float) -> Column:
    """Smallest exponent in [0, 1], to 60 halvings, at which the smallest source (share
    ``low``) is repeated no more than ``limit`` times as often as the largest (``top``)."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(at, _):
        mid = (at["lo"] + at["hi"]) / 2
        over = F.pow(top / low, 1 - mid) > limit
        return F.struct(F.when(over, mid).otherwise(at["lo"]).alias("lo"), F.when(over, at["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, halve, lambda at: at["hi"])
    return F.when(F.pow(top / low, 1) > limit, found).otherwise(F.lit(0.0))


def entropy_exponent(live: DataFrame, total: int, target: float) -> float:
    """The exponent in [0, 1] at which the weights' entropy falls to ``target``. A bisection
    of ``WAYS`` parts a round: each round is one aggregate over the table of sources, so
    their number has no bound. Only sums reach the driver."""
    share, lo, hi = F.col("tokens") / F.lit(total), 0.0, 1.0
    for _ in range(ENTROPY_ROUNDS):
        tries = [lo + (hi - lo) * i / WAYS for i in range(WAYS + 1)]
        sums = [f for a in tries for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * a * F.ln(share)))]
        got = live.agg(*[f.alias(str(i)) for i, f in enumerate(sums)]).first()
        over = sum(math.log(got[2 * i]) - got[2 * i + 1] / got[2 * i] > target for i in range(WAYS + 1))
        if over in (0, WAYS + 1):  # below the target at the start, above it at the end
            return lo if over == 0 else hi
        lo, hi = tries[over - 1], tries[over]
    return hi


def quotas(sources: DataFrame, repetition: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """key, docs, tokens, weight, epochs and rest (tokens of the last part of an epoch)
    from key, docs and tokens of each source (a written table)."""
    live = sources.filter("tokens > 0")
    one = live.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.min("tokens").alias("least"))
    one = one.withColumns({"top": F.col("most") / F.col("total"), "low": F.col("least") / F.col("total")})
    found = [repetition_exponent(F.col("top"), F.col("low"), repetition)] if repetition else []
    if entropy is not None:
        total = live.agg(F.sum("tokens")).first()[0]
        found.append(F.lit(entropy_exponent(live, total, entropy) if total else 0.0))
    one = one.withColumn("exponent", F.greatest(*found, F.lit(0.0)) if found else F.lit(1.0)).select("total", "exponent", "top")
    power = F.pow(F.col("tokens") / F.col("total"), F.col("exponent"))
    one = live.join(F.broadcast(one), how="left").groupBy("total", "exponent", "top").agg(F.sum(power).alias("norm"))  # one row
    # the largest source is the least repeated: used once, it sets the budget
    whole = F.col("top") * F.col("total") / (F.pow("top", "exponent") / F.col("norm"))
    one = one.withColumn("budget", F.lit(float(budget)) if budget is not None else whole)
    rows = sources.join(F.broadcast(one), how="left")  # one row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("norm")).otherwise(F.lit(0.0))
    rows = rows.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * F.col("budget")).cast("long"))
    epochs = F.when(F.col("tokens") > 0, F.expr("quota DIV greatest(tokens, 1)")).otherwise(F.lit(1).cast("long"))
    return rows.withColumn("epochs", epochs).select("key", "docs", "tokens", "weight", "epochs", F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"))


def mixing_plan(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row a source: key, weight, whole epochs, blocks, and the cut of the last epoch
    (documents up to ``cut_hash`` of ``cut_block``; -1: none)."""
    narrow = staged(docs.select("doc_id", source_key().alias("key"), n_words("text").alias("n")), "mix-lengths")
    sources = staged(narrow.groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")), "mix-sources")
    plan = staged(quotas(sources, repetition, entropy, budget).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_ROWS)), "mix-quotas")
    rows = joined(narrow, plan.filter("rest > 0").select("key", "epochs", "blocks", "rest"))
    rows = rows.withColumn("hash", order_hash(F.col("epochs"))).withColumn("block", F.expr("hash % blocks"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("key", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = staged(blocks.filter("base < rest AND rest <= base + n").select("key", "block", "base"), "mix-cuts")
    up_to = Window.partitionBy("key").orderBy("hash").rangeBetween(Window.unboundedPreceding, -1)
    within = joined(rows, cut, ["key", "block"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(up_to), F.lit(0)))
    cuts = within.filter("start < rest").groupBy("key").agg(F.first("block").alias("cut_block"), F.max("hash").alias("cut_hash"))
    plan = plan.join(cuts, "key", "left").select("key", "weight", "epochs", "blocks", F.coalesce("cut_block", F.lit(-1)).alias("cut_block"), F.coalesce("cut_hash", F.lit(-1)).alias("cut_hash"))
    return staged(plan, "mix-plan")


def joined(rows: DataFrame, sources: DataFrame, on: list[str] | str = "key") -> DataFrame:
    """Rows with what a written table says of their source. A table of a checked size is
    broadcast; a larger one is joined by shuffling, where a large source can be split."""
    return rows.join(F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources, on)


def mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the plan uses them: each as struct ``own``, with its
    epoch and block."""
    rows = joined(docs.select(packed(docs.columns).alias("own"), "doc_id", source_key().alias("key")), plan)
    last = order_hash(F.col("epochs"))
    block = F.pmod(last, F.col("blocks"))
    more = (block < F.col("cut_block")) | ((block == F.col("cut_block")) & (last <= F.col("cut_hash")))
    times = F.col("epochs") + F.when(more, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    return rows.select("own", "epoch", F.pmod(order_hash(F.col("epoch")), F.col("blocks")).alias("block"))


def mix_documents(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``docs`` mixed, its own columns."""
    return unpacked(mix(docs, mixing_plan(docs, repetition, entropy, budget)), "own", docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = mix(docs.select("doc_id", "source"), mixing_plan(docs))
    return rows.select("own.doc_id", "own.source", "epoch", "block")


def mix_sql(docs: str, repetition: float) -> str:
    """CTEs from ``docs`` to ``mixed`` (key columns, epoch and block)."""
    digest = "CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST({e} AS VARCHAR))), 1, 15) AS BIGINT)"
    return rf"""narrow AS MATERIALIZED (SELECT doc_id, text, lang, source, n_chars, coalesce('+' || source, '-') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM {docs}),
sources AS MATERIALIZED (SELECT key, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(ceil(count(*) / {BLOCK_ROWS}.0) AS BIGINT) AS blocks FROM narrow GROUP BY key),
shares AS MATERIALIZED (SELECT CAST(sum(tokens) AS BIGINT) AS total, max(tokens) / CAST(sum(tokens) AS DOUBLE) AS top, min(tokens) / CAST(sum(tokens) AS DOUBLE) AS low FROM sources WHERE tokens > 0),
halved AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT i + 1, CASE WHEN pow(top / low, 1 - (lo + hi) / 2) > {repetition} THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(top / low, 1 - (lo + hi) / 2) > {repetition} THEN hi ELSE (lo + hi) / 2 END FROM halved, shares WHERE i < {ROUNDS}),
exponent AS MATERIALIZED (SELECT CASE WHEN pow(top / low, 1) > {repetition} THEN hi ELSE 0 END AS a, total, top FROM halved, shares WHERE i = {ROUNDS}),
norm AS MATERIALIZED (SELECT a, total, top, sum(pow(tokens / CAST(total AS DOUBLE), a)) AS norm FROM sources, exponent WHERE tokens > 0 GROUP BY ALL),
quota AS MATERIALIZED (SELECT key, tokens, blocks, CASE WHEN tokens > 0 THEN CAST(round(pow(tokens / CAST(total AS DOUBLE), a) / norm * (top * total / (pow(top, a) / norm))) AS BIGINT) END AS quota FROM sources LEFT JOIN norm ON true),
plan AS MATERIALIZED (SELECT key, blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN quota - quota // tokens * tokens ELSE 0 END AS rest FROM quota),
last AS MATERIALIZED (SELECT *, hash % blocks AS b FROM (SELECT narrow.*, blocks, epochs, rest, {digest.format(e="epochs")} AS hash FROM narrow JOIN plan USING (key))),
steps AS MATERIALIZED (SELECT key, b, hash AS h, sum(n) AS s FROM last GROUP BY ALL),
sums AS MATERIALIZED (SELECT key, b, h, coalesce(sum(s) OVER (PARTITION BY key ORDER BY b, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM steps),
placed AS MATERIALIZED (SELECT last.*, sums.start FROM last JOIN sums ON last.key = sums.key AND last.b = sums.b AND last.hash = sums.h),
cut AS (SELECT *, rest > 0 AND start < rest AS more FROM placed),
mixed AS (SELECT * EXCLUDE (b), {digest.format(e="epoch")} % blocks AS block FROM (SELECT *, unnest(range(0, CAST(epochs + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM cut))"""


OP6_SQL = f"WITH RECURSIVE {mix_sql('documents', REPETITION)} SELECT doc_id, source, epoch, block FROM mixed"
