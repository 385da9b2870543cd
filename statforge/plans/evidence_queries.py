"""Registered evidence, provenance and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nulls import count_where
from ..operators.evidence import clusters, first_valid, fuzzy_jaccard, grade, identity_key, is_gray, phantoms, promotion, support, whole_number
from ..sources.tables import EVENTS, MATCHES, events, matches, read
from .registry import query

GRADED = "g AS (SELECT user_id, event_type AS v, count(*) AS votes, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS best, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM ev GROUP BY 1, 2)"


def graded(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"k": F.from_json("props", "k long")["k"], "v": F.col("event_type")})
    return support(e, ["user_id"], "v", "k")


@query(f"WITH {EVENTS}, {GRADED} SELECT user_id, v, votes, total, best FROM g")
def evidence_support(spark, sf_dir):
    return graded(spark, sf_dir)


@query(f"""WITH {EVENTS}, {GRADED}, r AS (SELECT *, v <> 'error' AS valid, lead(votes) OVER w AS next_votes, row_number() OVER w AS k FROM g WINDOW w AS (PARTITION BY user_id ORDER BY votes DESC, best DESC, v NULLS LAST))
SELECT user_id, v, votes, CASE WHEN v IS NULL THEN 'unobserved' WHEN NOT valid THEN 'invalid' WHEN best >= 98 THEN 'authority' WHEN next_votes IS NOT NULL AND votes < 1.5 * next_votes THEN 'contested' ELSE 'promoted' END AS verdict FROM r WHERE k = 1""")
def promotion_gate(spark, sf_dir):
    return promotion(graded(spark, sf_dir).withColumn("valid", F.col("v") != "error"), ["user_id"], "v", trusted=98).select("user_id", "v", "votes", "verdict")


@query(f"""WITH {EVENTS} SELECT user_id, CAST(arg_min(CASE WHEN event_type = 'click' THEN value END, event_id) FILTER (WHERE event_type = 'click') AS DOUBLE) AS click,
CAST(arg_min(value, event_id) FILTER (WHERE event_type = 'view' AND value > 20) AS DOUBLE) AS view FROM ev GROUP BY 1""")
def first_valid_merge(spark, sf_dir):
    e = events(spark, sf_dir)
    v = F.col("value").cast("double")
    e = e.withColumns({"click": F.when(F.col("event_type") == "click", v), "view": F.when((F.col("event_type") == "view") & (v > 20), v)})
    return first_valid(e, ["user_id"], ["event_id"], ["click", "view"])


@query("""WITH x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS id, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS tag, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT coalesce('p:' || id, 'g:' || lower(tag)) AS key, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM x GROUP BY 1""")
def identity_grouping(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    key = identity_key(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")), F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")))
    return o.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT o_custkey AS opponent_id, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1")
def last_seen_day(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("opponent_id"))
    return o.agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("""WITH c AS (SELECT p_brand, p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 53) % 256 AS g, (p_partkey * 91) % 256 AS b, p_size FROM part),
v AS (SELECT p_brand, p_type, 1 AS one FROM part), k AS (SELECT * FROM c WHERE greatest(r, g, b) - least(r, g, b) > 16)
SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS weight FROM k GROUP BY 1""")
def color_votes(spark, sf_dir):
    k = F.col("p_partkey")
    hexed = F.format_string("#%02x%02x%02x", k * 37 % 256, k * 53 % 256, k * 91 % 256)
    p = read(spark, sf_dir, "part").withColumn("color", hexed).filter(~is_gray(F.col("color")))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("weight"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_type, value, CASE WHEN value - lag(value) OVER w > 25 THEN 1 ELSE 0 END AS far FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY value)),
c AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY value) AS cluster FROM s) SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM c GROUP BY 1, 2""")
def row_clusters(spark, sf_dir):
    c = clusters(events(spark, sf_dir), ["user_id"], "value", 25)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))


@query("""WITH t AS (SELECT o_orderkey AS k, floor(o_totalprice / 1000) AS a, o_custkey AS b FROM orders), s AS (SELECT l_orderkey AS k, floor(max(l_extendedprice) / 1000) AS a, min(l_suppkey) AS b FROM lineitem GROUP BY 1),
j AS (SELECT abs(t.a - s.a) <= 20 AS a, abs(t.b - s.b) <= 20 AS b FROM t JOIN s USING (k)) SELECT 'a' AS field, count(*) AS compared, count_if(a) AS matched FROM j UNION ALL SELECT 'b', count(*), count_if(b) FROM j""")
def truth_grading(spark, sf_dir):
    t = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 1000).alias("a"), F.col("o_custkey").alias("b"))
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.floor(F.max("l_extendedprice") / 1000).alias("a"), F.min("l_suppkey").alias("b"))
    return grade(t, s, "k", ["a", "b"], tolerance=20)


@query("""WITH x AS (SELECT event_id, user_id, event_type, CAST(event_id % 23 AS VARCHAR) || ':' || lpad(CAST(event_id * 7 % 60 AS VARCHAR), 2, '0') AS clock, value > 50 AS placed FROM events),
p AS (SELECT a.event_id AS a, b.event_id AS b, a.placed, levenshtein(a.clock, b.clock) <= 1 AS near, replace(a.clock, ':', '') AS da, replace(b.clock, ':', '') AS db
      FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND a.placed <> b.placed)
SELECT CASE WHEN placed THEN b ELSE a END AS phantom, CASE WHEN placed THEN a ELSE b END AS canonical, CASE WHEN abs(len(da) - len(db)) = 1 AND (contains(da, db) OR contains(db, da)) THEN 'substring' ELSE 'levenshtein-1' END AS kind
FROM p WHERE near OR (abs(len(da) - len(db)) = 1 AND (contains(da, db) OR contains(db, da)))""")
def phantom_pairs(spark, sf_dir):
    n = F.col("event_id")
    clock = F.concat((n % 23).cast("string"), F.lit(":"), F.lpad((n * 7 % 60).cast("string"), 2, "0"))
    x = read(spark, sf_dir, "events").select(n.alias("id"), "user_id", "event_type", clock.alias("clock"), (F.col("value") > 50).alias("placed"))
    return phantoms(x, ["user_id", "event_type"])


@query("""WITH k AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2, 3)
SELECT o_custkey, o_orderpriority, CASE WHEN count_if(o_orderstatus <> 'P') = 0 THEN 'insert' WHEN sum(CASE WHEN o_orderstatus <> 'P' THEN n ELSE 0 END) = 1 THEN 'hit' ELSE 'ambiguous' END AS outcome FROM k GROUP BY 1, 2 HAVING bool_or(o_orderstatus = 'P')""")
def match_outcomes(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    pending = F.col("o_orderstatus") == "P"
    g = o.groupBy("o_custkey", "o_orderpriority").agg(F.bool_or(pending).alias("p"), F.count_if(~pending).alias("n")).filter("p")
    return g.select("o_custkey", "o_orderpriority", F.when(F.col("n") == 0, "insert").when(F.col("n") == 1, "hit").otherwise("ambiguous").alias("outcome"))


@query("""SELECT event_id, CASE WHEN t = '' THEN 0 ELSE TRY_CAST(t AS BIGINT) END AS number, CASE WHEN k BETWEEN 14 AND 28 THEN k * 10 END AS weight, CASE code WHEN 1 THEN 'WIN' WHEN 2 THEN 'LOSS' WHEN 5 THEN 'WIN' WHEN 6 THEN 'OTL' WHEN 10 THEN 'LOSS' ELSE 'DNF' END AS result
FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 11 AS code, CASE event_id % 4 WHEN 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS t FROM events)""")
def parse_numbers(spark, sf_dir):
    n, k = F.col("event_id"), F.from_json("props", "k long")["k"]
    text = F.when(n % 4 == 0, "").otherwise(n.cast("string"))
    code = n % 11
    result = F.when(code.isin(1, 5), "WIN").when(code.isin(2, 10), "LOSS").when(code == 6, "OTL").otherwise("DNF")
    return read(spark, sf_dir, "events").select("event_id", whole_number(text).alias("number"), F.when(k.between(14, 28), k * 10).alias("weight"), result.alias("result"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part), j AS (SELECT p_partkey, a, ['cold', 'bolts'] AS b FROM w),
n AS (SELECT p_partkey, len(a) AS la, len(list_filter(a, lambda x: levenshtein(x, 'cold') <= 1 OR levenshtein(x, 'bolts') <= 1)) AS shared FROM j)
SELECT p_partkey, CAST(shared AS DOUBLE) / (la + 2 - shared) AS similarity FROM n""")
def fuzzy_sets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", fuzzy_jaccard(F.split("p_name", " "), F.array(F.lit("cold"), F.lit("bolts"))).alias("similarity"))


@query(f"""WITH {MATCHES}, s AS (SELECT opponent_id, mode, count(*) AS gp FROM matches GROUP BY 1, 2)
SELECT opponent_id, mode, gp, CAST(gp AS DOUBLE) / sum(gp) OVER (PARTITION BY opponent_id) AS usage FROM s QUALIFY row_number() OVER (PARTITION BY opponent_id ORDER BY gp DESC, mode NULLS LAST) <= 2""")
def position_usage(spark, sf_dir):
    s = matches(spark, sf_dir).groupBy("opponent_id", "mode").agg(F.count("*").alias("gp"))
    w = Window.partitionBy("opponent_id")
    k = F.row_number().over(w.orderBy(F.desc("gp"), F.asc_nulls_last("mode")))
    s = s.withColumns({"usage": F.col("gp").cast("double") / F.sum("gp").over(w), "k": k})
    return s.filter("k <= 2").drop("k")


@query(f"""WITH {MATCHES}, t AS (SELECT title, mode, count(*) AS gp, count_if(result = 'WIN') AS wins FROM matches GROUP BY 1, 2)
SELECT title, CASE WHEN count(*) = 0 THEN NULL WHEN bool_or(mode IS NULL) AND count(mode) >= 4 THEN 'reconciled' WHEN count(mode) < 4 THEN 'review' ELSE 'n/a' END AS verdict, CAST(sum(gp) AS BIGINT) AS gp, CAST(sum(wins) AS BIGINT) AS wins FROM t GROUP BY 1""")
def reconciliation_verdict(spark, sf_dir):
    t = matches(spark, sf_dir).groupBy("title", "mode").agg(F.count("*").alias("gp"), count_where(F.col("result") == "WIN").alias("wins"))
    g = t.groupBy("title").agg(F.sum("gp").alias("gp"), F.sum("wins").alias("wins"), F.count("mode").alias("seen"), F.bool_or(F.col("mode").isNull()).alias("total"))
    verdict = F.when(F.col("total") & (F.col("seen") >= 4), "reconciled").when(F.col("seen") < 4, "review").otherwise("n/a")
    return g.select("title", verdict.alias("verdict"), "gp", "wins")
