"""Registered joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nulls import count_where
from ..operators.joins import band_pairs, resolve_cascade, resolve_persona, units_with_all, with_without
from ..sources.tables import EVENTS, MATCHES, PLAYERS, events, matches, player_matches, read
from .aggregate_queries import PAIRS, SEASON, pair_results
from .registry import query


@query(f"WITH {PAIRS} SELECT a, b, gp, wins FROM pairs WHERE gp >= 5")
def pairs_min_gp(spark, sf_dir):
    return pair_results(spark, sf_dir).filter("gp >= 5").select("a", "b", "gp", "wins")


@query(f"""WITH {SEASON}, u AS (SELECT match_id, CAST(result = 'WIN' AS INTEGER) AS win FROM matches), s AS (SELECT DISTINCT player_id, match_id FROM season)
SELECT p.player_id, count(s.match_id) AS with_gp, CAST(coalesce(sum(CASE WHEN s.match_id IS NOT NULL THEN win END), 0) AS BIGINT) AS with_win, count(*) - count(s.match_id) AS without_gp, CAST(coalesce(sum(CASE WHEN s.match_id IS NULL THEN win END), 0) AS BIGINT) AS without_win
FROM (SELECT DISTINCT player_id FROM season) p CROSS JOIN u LEFT JOIN s ON s.player_id = p.player_id AND s.match_id = u.match_id GROUP BY 1""")
def with_without_splits(spark, sf_dir):
    units = matches(spark, sf_dir).select("match_id", F.lit(1).cast("long").alias("gp"), (F.col("result") == "WIN").cast("long").alias("win"))
    return with_without(player_matches(spark, sf_dir).select("player_id", "match_id"), units, "player_id", "match_id", ["gp", "win"])


@query(f"WITH {PLAYERS} SELECT match_id FROM pm GROUP BY 1 HAVING bool_or(player_id % 5 = 1 AND is_goalie) AND bool_or(player_id % 5 = 2 AND NOT is_goalie)")
def lineup_division(spark, sf_dir):
    c = F.col("player_id") % 5
    return units_with_all(player_matches(spark, sf_dir), "match_id", [(c == 1) & F.col("is_goalie"), (c == 2) & ~F.col("is_goalie")])


@query(f"""WITH {EVENTS}, e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM ev)
SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.day = y.day AND x.event_id < y.event_id AND abs(x.value - y.value) <= 1""")
def band_join(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return band_pairs(e, ["user_id", "day"], "value", "event_id", 1).select("user_id", "a", "b")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, list(event_id) AS ids FROM ev WHERE event_type = 'purchase' GROUP BY 1), w AS (SELECT list(event_id) AS evidence FROM ev WHERE value > 95)
SELECT DISTINCT user_id FROM g, w WHERE list_has_any(ids, evidence)""")
def array_semi(spark, sf_dir):
    e = events(spark, sf_dir)
    evidence = e.filter("value > 95").select("event_id")
    return e.filter("event_type = 'purchase'").join(evidence, "event_id", "left_semi").select("user_id").distinct()


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 440000)""")
def not_in_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL")
    known = o.filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_custkey").union(o.filter("o_totalprice > 440000").select("o_custkey")).distinct()
    return read(spark, sf_dir, "customer").select("c_custkey").join(known, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH live AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1), old AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE year(o_orderdate) < 1998 GROUP BY 1)
SELECT c_custkey AS id, coalesce(live.n, old.n) AS n, CASE WHEN live.n IS NOT NULL THEN 'live' WHEN old.n IS NOT NULL THEN 'old' END AS origin FROM customer LEFT JOIN live ON live.id = c_custkey LEFT JOIN old ON old.id = c_custkey""")
def priority_merge(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(*[F.nullif(count_where(c), F.lit(0).cast("long")).alias(n) for c, n in ((F.year("o_orderdate") >= 1998, "live"), (F.year("o_orderdate") < 1998, "old"))])
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left")
    return c.select("id", F.coalesce("live", "old").alias("n"), F.when(F.col("live").isNotNull(), "live").when(F.col("old").isNotNull(), "old").alias("origin"))


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) AS last_turn FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def nest_children(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    kids = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(kids, lambda x: x["role"]), ",").alias("roles"), F.max("turn").alias("last_turn"))


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^[\s.\-]+', ''), '[(\[].*$', ''), '[\s.,;:!\-]+$', ''))"
#: Snapshots of every customer: as it is, a former name, an alias, a part, a letter lost, a letter changed or noise.
SNAPSHOTS = """CASE c_nationkey % 7 WHEN 0 THEN '- ' || upper(c_name) || ' (C)' WHEN 1 THEN 'supplier#' || right(c_name, 9) WHEN 2 THEN n_name WHEN 3 THEN right(c_name, 9)
  WHEN 4 THEN replace(c_name, 'tom', 'tm') || '.' WHEN 5 THEN replace(c_name, 'C', 'K') ELSE 'zz' || c_mktsegment END"""


@query(f"""WITH p AS (SELECT c_custkey AS id, lower({CLEAN.format(c="snapshot")}) AS name FROM (SELECT c_custkey, {SNAPSHOTS} AS snapshot FROM customer JOIN nation ON c_nationkey = n_nationkey)),
k AS (SELECT lower(c_name) AS name, 1 AS step, c_custkey AS player_id FROM customer UNION ALL SELECT lower(s_name), 2, s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT lower(n_name), 3, n_nationkey FROM nation),
t AS (SELECT c_custkey AS player_id, lower(c_name) AS tag FROM customer WHERE c_acctbal > 0),
e AS (SELECT id, step, min(player_id) AS player_id FROM p JOIN k USING (name) GROUP BY 1, 2),
o AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM e) AND name <> ''),
f AS (SELECT id, 4 AS step, player_id FROM o JOIN t ON contains(name, tag) OR contains(tag, name) UNION ALL SELECT id, 5, player_id FROM o JOIN t ON levenshtein(name, tag) <= 1),
u AS (SELECT id, step, min(player_id) AS player_id FROM f GROUP BY 1, 2 HAVING count(DISTINCT player_id) = 1),
r AS (SELECT * FROM (SELECT * FROM e UNION ALL SELECT * FROM u) QUALIFY row_number() OVER (PARTITION BY id ORDER BY step) = 1)
SELECT p.id, r.player_id, (['gamertag_exact', 'gamertag_history_exact', 'display_alias_exact', 'gamertag_substring', 'gamertag_levenshtein', 'unresolved'])[coalesce(step, 6)] AS via FROM p LEFT JOIN r USING (id)""")
def fuzzy_resolve(spark, sf_dir):
    c, s, n = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    probes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.expr(SNAPSHOTS).alias("snapshot"))
    players = c.select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("gamertag"), (F.col("c_acctbal") > 0).alias("is_active"))
    history = s.select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("gamertag"), (F.col("s_acctbal") > 0).alias("in_use"))
    aliases = n.select(F.col("n_nationkey").cast("long").alias("player_id"), F.col("n_name").alias("alias"))
    return resolve_cascade(probes, players, history, aliases)


@query(f"""WITH p AS (SELECT c_custkey AS id, {CLEAN.format(c="snapshot")} AS cleaned FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN substr(n_name, 2) WHEN c_acctbal < 3000 THEN n_name || '!' WHEN c_acctbal < 6000 THEN c_mktsegment ELSE ' (x' END AS snapshot FROM customer JOIN nation ON c_nationkey = n_nationkey)),
m AS (SELECT id, n_name AS canonical, lower(n_name) <> lower(cleaned) AS far FROM p JOIN nation ON levenshtein(lower(cleaned), lower(n_name)) <= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY lower(n_name) <> lower(cleaned), lower(n_name)) = 1)
SELECT id, coalesce(canonical, cleaned) AS canonical, CASE WHEN m.id IS NULL THEN 'raw' WHEN far THEN 'fuzzy_alias' ELSE 'exact_alias' END AS via FROM (SELECT * FROM p WHERE cleaned <> '') p LEFT JOIN m USING (id)""")
def persona_resolve(spark, sf_dir):
    c, n = (read(spark, sf_dir, t) for t in ("customer", "nation"))
    b = F.col("c_acctbal")
    shown = F.when(b < 0, F.expr("substr(n_name, 2)")).when(b < 3000, F.concat("n_name", F.lit("!"))).when(b < 6000, F.col("c_mktsegment")).otherwise(" (x")
    probes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), shown.alias("snapshot"))
    return resolve_persona(probes, n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical")))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, CAST(o_totalprice AS BIGINT) AS v FROM orders),
c AS (SELECT x.id, y.id AS other, CASE WHEN abs(x.v - y.v) < 50000 THEN 50 ELSE 0 END + greatest(0, 30 - abs(date_diff('day', x.o_orderdate, y.o_orderdate))) AS score FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.id <> y.id),
r AS (SELECT id, other, score, score - coalesce(lead(score) OVER w, 0) AS gap, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY id ORDER BY score DESC, other))
SELECT id, other, CAST(score AS BIGINT) AS score, CAST(gap AS BIGINT) AS gap FROM r WHERE k = 1 AND score >= 50""")
def record_linkage(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", F.col("o_totalprice").alias("v"))
    v = F.when(F.col("v") - F.floor("v") == 0.5, 2 * F.round(F.col("v") / 2)).otherwise(F.floor(F.col("v") + 0.5)).cast("long")  # ties to even
    x, y = (o.select(F.col("id").alias(a), "o_custkey", F.col("o_orderdate").alias(f"{a}_day"), v.alias(f"{a}_v")) for a in ("id", "other"))
    days = F.abs(F.datediff("id_day", "other_day"))
    score = F.when(F.abs(F.col("id_v") - F.col("other_v")) < 50000, 50).otherwise(0) + F.greatest(F.lit(0), 30 - days)
    c = x.join(y, "o_custkey").filter("id <> other").withColumn("score", score.cast("long"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.asc("other"))
    r = c.withColumns({"gap": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0)), "k": F.row_number().over(w)})
    return r.filter("k = 1 AND score >= 50").select("id", "other", "score", "gap")


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, bool_or(event_type = 'view') AS a, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS c FROM ev WHERE event_type IN ('view', 'click', 'purchase') AND value > 60 GROUP BY 1)
SELECT *, CASE CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) WHEN 3 THEN 'full' WHEN 2 THEN 'partial' ELSE 'minimal' END AS tier FROM f""")
def coverage_flags(spark, sf_dir):
    kinds = {"a": "view", "b": "click", "c": "purchase"}
    e = events(spark, sf_dir).filter(F.col("event_type").isin(*kinds.values()) & (F.col("value") > 60))
    f = e.groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == k).alias(n) for n, k in kinds.items()])
    n = sum((F.col(k).cast("int") for k in ("b", "c")), F.col("a").cast("int"))
    return f.withColumn("tier", F.when(n == 3, "full").when(n == 2, "partial").otherwise("minimal"))


@query("""SELECT doc_id, d FROM (SELECT doc_id, sha256(text) AS d, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1""")
def hash_dedup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return d.groupBy("d").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "d")


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, value FROM ev),
l AS (SELECT x.event_id AS a, y.event_id AS b FROM p x JOIN p y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type = y.event_type AND x.event_id < y.event_id AND abs(x.value - y.value) <= 5)
SELECT event_id FROM p WHERE event_id NOT IN (SELECT b FROM l)""")
def near_dup_events(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(epoch_days()))
    dup = band_pairs(e, ["user_id", "day", "event_type"], "value", "event_id", 5)
    return e.select("event_id").join(dup, F.col("event_id") == F.col("b"), "left_anti")


def epoch_days():
    return F.col("ts").cast("long") / 86400


@query("""SELECT d.doc_id, CASE WHEN d.source = 'src0' OR l.quality = 1 THEN d.n_chars END AS n_chars, CASE WHEN d.source = 'src0' OR l.toxic = 0 THEN d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE d.source = 'src0' OR l.quality = 1 OR l.toxic = 0""")
def mask_family(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    own = F.col("source") == "src0"
    first, second = own | (F.col("quality") == 1), own | (F.col("toxic") == 0)
    return d.filter(first | second).select("doc_id", F.when(first, F.col("n_chars")).alias("n_chars"), F.when(second, F.col("lang")).alias("lang"))


@query(f"""WITH {MATCHES}, o AS (SELECT opponent_id, CAST(sum(score) AS DOUBLE) AS total FROM matches WHERE title <= 1996 GROUP BY 1), n AS (SELECT opponent_id, CAST(sum(score) AS DOUBLE) AS total FROM matches WHERE title > 1996 GROUP BY 1)
SELECT opponent_id, coalesce(o.total, n.total) AS total FROM o FULL JOIN n USING (opponent_id)""")
def upsert_preserve(spark, sf_dir):
    from ..sources.tables import merged

    m = matches(spark, sf_dir)
    old, new = (m.filter(c).groupBy("opponent_id").agg(F.sum("score").cast("double").alias("total")) for c in ("title <= 1996", "title > 1996"))
    return merged(old, new, ["opponent_id"])


@query("""SELECT o_orderkey AS match_id, s_name, n_name, c_name, CASE WHEN o_orderstatus = 'F' THEN c_mktsegment END AS segment FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem GROUP BY 1) f ON f.l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = f.k""")
def event_detail_join(spark, sf_dir):
    o, c, n, s = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier"))
    f = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(f, "o_orderkey", "left").join(s, "s_suppkey", "left")
    return j.select(F.col("o_orderkey").alias("match_id"), "s_name", "n_name", "c_name", F.when(F.col("o_orderstatus") == "F", F.col("c_mktsegment")).alias("segment"))
