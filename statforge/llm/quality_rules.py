"""Operator 4: quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer whose bits are the rules that failed. A policy is a version number with a mask;
applying it, or asking what another policy would have kept, reads the ledger alone.

Measurements are per text, so nothing is shuffled. Repeated 5-word windows are found by
hashing each window, and only where hashes repeat within the text are they sorted to
mark the words they cover.

Nulls: a null text has no words and fails ``few_words``; a null doc_id is carried. Repeated
rows are judged each on its own, a very long text is measured whole in one task's memory, an
empty table gives an empty ledger, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, unpacked

SPACES = " \t\n\x0b\f\r"
WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: name -> SQL condition under which a document fails; the position is the bit.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = ["few_words", "repeated_words"]
#: version -> rules that reject.
POLICIES = {1: BASE, 2: [*BASE, "symbols", "repeated_lines"], 3: list(RULES)}
CURRENT = 3


def mask_of(rules: list[str]) -> int:
    return sum(1 << BIT[r] for r in rules)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus the measurements, all long."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    core = F.btrim(text, F.lit(SPACES))
    words = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.withColumns({"_words": words, "_lines": lines})
    n = F.size("_words")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    out = out.withColumn("_hashes", hashes)
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_sorted", F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get(F.col("_sorted"), i)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total"), i.alias("last")),
        lambda a: a["total"],
    )
    # A partition id is not deterministic to the optimizer, so later filters on measurements
    # stay above this projection and are not copied into each of those below it.
    measures = {
        "n_words": F.when(F.spark_partition_id() >= 0, n),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return out.withColumns({k: v.cast("long") for k, v in measures.items()}).drop("_words", "_lines", "_hashes", "_sorted")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``rule_bits`` (bit i: rule i failed)."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", *MEASURES, total.cast("long").alias("rule_bits"))


def fails(rules: list[str], bits: str = "rule_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(rules))) != 0


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the policy's version to ledger rows."""
    return rows.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(POLICIES[version]), "policy": F.lit(version).cast("long")})


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that would be kept
    without it. Rows are first counted by distinct bits, at most 2 ** rules of them."""
    rules = POLICIES[version]
    patterns = rows.select(F.col("rule_bits").bitwiseAND(F.lit(mask_of(rules))).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) for r in rules for c in (fails([r], "bits"), F.col("bits") == (1 << BIT[r]))]
    one = patterns.agg(F.array(*[F.struct(F.lit(r).alias("rule"), sums[2 * i].alias("failed"), sums[2 * i + 1].alias("only_this")) for i, r in enumerate(rules)]).alias("x"))
    return one.select(F.inline("x"))


def keep_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    names = docs.columns
    condition = F.lit(False)
    for r in dict.fromkeys([*BASE, *POLICIES[version]]):
        condition = condition | F.expr(RULES[r])
    return unpacked(measured(docs.select(packed(docs.columns).alias("own"), "text")).filter(~condition), "own", names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents")))


MEASURE_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measures AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))"""

BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))

OP4_SQL = f"""WITH {MEASURE_SQL.replace("{docs}", "documents")},
ledger AS (SELECT *, CAST({BITS_SQL} AS BIGINT) AS rule_bits FROM measures)
SELECT *, (rule_bits & {mask_of(BASE)}) <> 0 AS base_failed,
       (rule_bits & {mask_of(BASE) | mask_of(POLICIES[CURRENT])}) = 0 AS kept, CAST({CURRENT} AS BIGINT) AS policy
FROM ledger"""
