"""Registered aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nulls import D, count_where, ratio, strict_sum
from ..functions.text import record_text
from ..operators.aggregates import element_sums, first_seen_mode, member_means, rollup_modes, top_value, upper_median, weighted_mode
from ..operators.joins import unordered_pairs
from ..sources.tables import EVENTS, MATCHES, PLAYERS, events, matches, player_matches, read
from .registry import query


def rate_sql(n, d, t=100):
    """Half away from zero at two digits in exact arithmetic, as doubles would not be."""
    return f"CASE WHEN {d} > 0 THEN CAST((CAST({n} AS HUGEINT) * {t} * 1000 // ({d}) + 5) // 10 AS DOUBLE) / 100 END"


def season(spark, sf_dir):
    return player_matches(spark, sf_dir).join(matches(spark, sf_dir), "match_id")


SEASON = f"{MATCHES}, {PLAYERS}, season AS (SELECT * FROM pm JOIN matches USING (match_id))"


@query(f"""WITH {SEASON}, agg AS (SELECT player_id, count(*) AS gp, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shifts) AS BIGINT) AS shifts,
  CAST(sum(CASE WHEN is_goalie THEN goals END) AS BIGINT) AS goalie_goals, count_if(is_goalie) AS goalie_gp, CAST(sum(saves) AS BIGINT) AS saves,
  count_if(result = 'WIN') AS wins, count_if(result = 'LOSS') AS losses, count_if(result = 'OTL') AS otl FROM season GROUP BY player_id)
SELECT s_name AS player, agg.*, {rate_sql('wins', 'wins + losses + otl')} AS win_pct, {rate_sql('saves', 'goals')} AS save_pct, {rate_sql('goals', 'shifts', 3600)} AS per_hour
FROM agg JOIN supplier ON s_suppkey = player_id""")
def player_season_agg(spark, sf_dir):
    s = season(spark, sf_dir)
    agg = s.groupBy("player_id").agg(
        F.count("*").alias("gp"), F.sum("goals").alias("goals"), F.sum("shifts").alias("shifts"), F.sum(F.when(F.col("is_goalie"), F.col("goals"))).alias("goalie_goals"),
        count_where(F.col("is_goalie")).alias("goalie_gp"), F.sum("saves").alias("saves"),
        *[count_where(F.col("result") == r).alias(n) for r, n in (("WIN", "wins"), ("LOSS", "losses"), ("OTL", "otl"))],
    )
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player"))
    out = agg.join(names, "player_id").withColumns({"win_pct": floor_rate("wins", F.col("wins") + F.col("losses") + F.col("otl")), "save_pct": floor_rate("saves", F.col("goals")), "per_hour": floor_rate("goals", F.col("shifts"), 3600)})
    return out.orderBy(F.desc("goals"), F.asc("player"))


def floor_rate(num: str, den, times: int = 100):
    """Two digits, half up, in whole numbers throughout (counts are not negative)."""
    n, d = F.col(num).cast("decimal(28,0)"), den.cast("decimal(20,0)")
    return F.when(den > 0, (F.floor((F.floor(n * times * 1000 / d) + 5) / 10) / F.lit(100)).cast("double"))


@query(f"""WITH {SEASON}, g AS (SELECT title, count(*) AS n, CAST(sum(goals) AS BIGINT) AS goals FROM season GROUP BY title),
m AS (SELECT title, count(*) AS gp, count_if(result = 'WIN') AS wins, CAST(sum(score) AS DOUBLE) AS score FROM matches GROUP BY title)
SELECT m.*, coalesce(goals, 0) AS goals, {rate_sql('coalesce(goals, 0)', 'gp', 1)} AS per_game FROM m LEFT JOIN g USING (title)""")
def club_agg_scalar(spark, sf_dir):
    g = season(spark, sf_dir).groupBy("title").agg(F.sum("goals").alias("goals"))
    m = matches(spark, sf_dir).groupBy("title").agg(F.count("*").alias("gp"), count_where(F.col("result") == "WIN").alias("wins"), F.sum("score").cast("double").alias("score"))
    return m.join(g, "title", "left").withColumn("goals", F.coalesce("goals", F.lit(0).cast("long"))).withColumn("per_game", floor_rate("goals", F.col("gp"), 1))


@query(f"""WITH {SEASON} SELECT player_id, mode, grouping(mode) = 1 AS is_total, count(*) AS gp, CAST(sum(goals) AS BIGINT) AS goals FROM season GROUP BY GROUPING SETS ((player_id), (player_id, mode))""")
def mode_rollup(spark, sf_dir):
    rows = rollup_modes(season(spark, sf_dir), "player_id", "mode", F.count("*").alias("gp"), F.sum("goals").alias("goals"))
    return rows.withColumn("is_total", F.col("is_total") == 1)


@query(f"""WITH {SEASON}, two AS (SELECT player_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shifts) AS BIGINT) AS shifts FROM season WHERE title >= 1997 GROUP BY 1
  UNION ALL SELECT player_id, CAST(sum(goals) AS BIGINT), CAST(sum(shifts) AS BIGINT) FROM season WHERE title < 1997 GROUP BY 1),
t AS (SELECT player_id, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(shifts) AS BIGINT) AS shifts FROM two GROUP BY 1)
SELECT *, {rate_sql('goals', 'shifts', 1)} AS per_shift FROM t""")
def alltime_two_source(spark, sf_dir):
    s = season(spark, sf_dir)
    sums = [F.sum("goals").alias("goals"), F.sum("shifts").alias("shifts")]
    live, old = (s.filter(c).groupBy("player_id").agg(*sums) for c in ("title >= 1997", "title < 1997"))
    return live.unionByName(old).groupBy("player_id").agg(*sums).withColumn("per_shift", floor_rate("goals", F.col("shifts"), 1))


@query("""SELECT l_suppkey AS player_id, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_discount * 100 AS INTEGER) * CAST(l_quantity AS BIGINT) END) AS DOUBLE)
  / CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) END) AS DOUBLE) AS mean_discount, count(*) AS n FROM lineitem GROUP BY 1""")
def weighted_avg_nullaware(spark, sf_dir):
    v = F.when(F.col("l_returnflag") != "N", F.round(F.col("l_discount") * 100).cast("int"))
    w = F.col("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player_id")).agg((F.sum(v * w).cast("double") / F.sum(F.when(v.isNotNull(), w)).cast("double")).alias("mean_discount"), F.count("*").alias("n"))


@query(f"""WITH {MATCHES}, a AS (SELECT mode, count(*) AS gp, count_if(result = 'WIN') AS wins, count_if(result = 'LOSS') AS losses, count_if(result = 'OTL') AS otl, CAST(sum(floor(score)) AS BIGINT) AS t FROM matches GROUP BY mode)
SELECT mode, gp, wins || '-' || losses || '-' || otl AS record, lpad(CAST((t // gp // 60) AS VARCHAR), 6, '0') || ':' || lpad(CAST((t // gp % 60) AS VARCHAR), 2, '0') AS avg_time FROM a""")
def live_mode_row_mmss(spark, sf_dir):
    a = matches(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("gp"), *[count_where(F.col("result") == r).alias(n) for r, n in (("WIN", "w"), ("LOSS", "l"), ("OTL", "o"))], F.sum(F.floor("score")).cast("long").alias("t"))
    per = F.expr("t DIV gp")
    clock = F.concat(F.lpad(F.floor(per / 60).cast("string"), 6, "0"), F.lit(":"), F.lpad((per % 60).cast("string"), 2, "0"))
    return a.select("mode", "gp", record_text(F.col("w"), F.col("l"), F.col("o")).alias("record"), clock.alias("avg_time"))


@query(f"""WITH {SEASON} SELECT count(*) AS rows_n, count(DISTINCT player_id) AS players, count(DISTINCT opponent_id) AS opponents, (SELECT count(*) FROM customer) AS clubs FROM season""")
def global_count_distinct(spark, sf_dir):
    a = season(spark, sf_dir).agg(F.count("*").alias("rows_n"), F.countDistinct("player_id").alias("players"), F.countDistinct("opponent_id").alias("opponents"))
    return a.crossJoin(read(spark, sf_dir, "customer").agg(F.count("*").alias("clubs")))  # one row each


@query(f"""WITH {EVENTS} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS over_50, count(*) FILTER (WHERE value <= 5) AS low,
  CAST(sum(value) AS DOUBLE) / count(*) AS mean, CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM ev GROUP BY 1""")
def filter_agg_panel(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), count_where(v > 50).alias("over_50"), count_where(v <= 5).alias("low"), (F.sum(v).cast("double") / F.count("*")).alias("mean"), F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi"),
    )


@query(f"""WITH {EVENTS} SELECT user_id, {", ".join(f"CAST(max(value) FILTER (WHERE event_type = '{t}') AS DOUBLE) AS {t}" for t in ("view", "click", "purchase"))} FROM ev GROUP BY 1 HAVING count(*) >= 3""")
def pivot_eav(spark, sf_dir):
    kinds = ["view", "click", "purchase"]
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).cast("double").alias(k) for k in kinds], F.count("*").alias("n")).filter("n >= 3").drop("n")


@query("SELECT o_custkey AS opponent_id, count(*) AS gp FROM orders GROUP BY 1 HAVING count(*) >= 5")
def having_min_count(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("opponent_id")).agg(F.count("*").alias("gp")).filter("gp >= 5")


@query("SELECT n AS copies, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY n")
def dup_detect(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).filter("copies > 1")
    return d.groupBy("copies").agg(F.count("*").alias("keys"), F.sum(F.col("copies") - 1).alias("surplus"))


@query(f"WITH {MATCHES} SELECT opponent_id, count_if(result = 'WIN') AS w, count_if(result = 'LOSS') AS l, count_if(result = 'OTL') AS o FROM matches GROUP BY 1")
def record_fold(spark, sf_dir):
    g = matches(spark, sf_dir).groupBy("opponent_id").pivot("result", ["WIN", "LOSS", "OTL"]).count()
    return g.select("opponent_id", *[F.coalesce(r, F.lit(0).cast("long")).alias(n) for r, n in (("WIN", "w"), ("LOSS", "l"), ("OTL", "o"))])


@query("""SELECT o_orderkey AS match_id, CAST(greatest(CAST(o_totalprice AS DECIMAL(18,2)), coalesce(s, 0)) AS DOUBLE) AS best, s IS NULL AS only_header
FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def reconcile_two_measures(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    m = matches(spark, sf_dir).select("match_id", "score").join(s, "match_id", "left")
    return m.select("match_id", F.greatest("score", F.coalesce("s", F.lit(0).cast("decimal(18,2)"))).cast("double").alias("best"), F.col("s").isNull().alias("only_header"))


@query(f"SELECT label, count(*) AS n, {', '.join(f'CAST(sum(CAST(round(embedding[{i + 1}] * 1000) AS BIGINT)) AS BIGINT) AS e{i}' for i in range(8))} FROM embeddings GROUP BY 1")
def array_sum_avg(spark, sf_dir):
    thousand = F.lit(1000).cast("float")  # single precision and halves away from zero, as in SQL
    e = read(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.round((x * thousand).cast("float"))).alias("x"))
    rows = element_sums(e, "label", "x", 8, 0)
    return rows.select("label", "n", *[F.col(f"e{i}").cast("long").alias(f"e{i}") for i in range(8)])


FIRST = "row_number() OVER (PARTITION BY user_id ORDER BY {order}) = 1"


@query(f"WITH {EVENTS} SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM ev GROUP BY 1, 2) QUALIFY {FIRST.format(order='votes DESC, seen')}")
def mode_first_seen(spark, sf_dir):
    return first_seen_mode(events(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query(f"""WITH {EVENTS} SELECT user_id, event_type, CAST(weight AS DOUBLE) AS weight FROM (SELECT user_id, event_type, sum(CASE WHEN value > 100 THEN 1 ELSE value END) AS weight, min(event_id) AS seen FROM ev GROUP BY 1, 2)
QUALIFY {FIRST.format(order='weight DESC, seen')}""")
def weighted_mode_vote(spark, sf_dir):
    e = events(spark, sf_dir)
    return weighted_mode(e, ["user_id"], "event_type", F.when(F.col("value") <= 100, F.col("value")), "event_id").withColumn("weight", F.col("weight").cast("double"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id) AS has FROM ev),
v AS (SELECT user_id, CAST(floor(value / 50) AS BIGINT) AS band, count(*) AS votes, min(event_id) AS seen FROM s WHERE NOT has OR event_type = 'purchase' GROUP BY 1, 2)
SELECT user_id, band, votes FROM v QUALIFY {FIRST.format(order='votes DESC, seen')}""")
def source_preferred_vote(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("has", F.bool_or(F.col("event_type") == "purchase").over(Window.partitionBy("user_id")))
    kept = e.filter(~F.col("has") | (F.col("event_type") == "purchase")).withColumn("band", F.floor(F.col("value") / 50).cast("long"))
    return first_seen_mode(kept, ["user_id"], "band", "event_id")


@query(f"""WITH {EVENTS}, v AS (SELECT user_id, CAST(floor(value / 20) AS BIGINT) AS band, count(*) AS votes, min(event_id) AS seen FROM ev GROUP BY 1, 2)
SELECT user_id, CASE WHEN votes >= 2 THEN band END AS band FROM v QUALIFY {FIRST.format(order='votes DESC, seen')}""")
def plurality_support(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 20).cast("long"))
    return first_seen_mode(e, ["user_id"], "band", "event_id").select("user_id", F.when(F.col("votes") >= 2, F.col("band")).alias("band"))


@query("""WITH v AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, lang, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS share, 10 * n < 6 * sum(n) OVER (PARTITION BY source) AS warn FROM v
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def modal_share(spark, sf_dir):
    v = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    v = v.withColumn("all", F.sum("n").over(Window.partitionBy("source")))
    top = top_value(v, ["source"], "lang", [F.desc("n"), F.asc("lang")])
    return top.select("source", "lang", (F.col("n").cast("double") / F.col("all").cast("double")).alias("share"), (F.col("n") * 10 < F.col("all") * 6).alias("warn"))


@query("""SELECT l_orderkey AS match_id, CASE WHEN count(*) = 1 THEN 'single_source' WHEN count(DISTINCT l_returnflag) = 1 THEN 'agree' ELSE 'conflict' END AS state,
  CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value FROM lineitem GROUP BY 1""")
def consensus_state(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.count("*").alias("n"), F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    one = F.col("lo") == F.col("hi")
    return g.select("match_id", F.when(F.col("n") == 1, "single_source").when(one, "agree").otherwise("conflict").alias("state"), F.when(one, F.col("lo")).alias("value"))


@query(f"WITH {EVENTS} SELECT user_id, CAST(sum(value) AS DOUBLE) / count(*) AS mean FROM ev WHERE starts_with(event_type, 's') OR ends_with(event_type, 'ck') GROUP BY 1")
def prefix_mean(spark, sf_dir):
    e = events(spark, sf_dir).filter(F.col("event_type").startswith("s") | F.col("event_type").endswith("ck"))
    return e.groupBy("user_id").agg((F.sum("value").cast("double") / F.count("*")).alias("mean"))


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_discount < 0.08 THEN CAST(l_quantity AS BIGINT) END AS q FROM lineitem)
SELECT l_orderkey AS match_id, CASE WHEN count(q) = count(*) THEN CAST(sum(q) AS BIGINT) END AS strict_total, CAST(sum(q) AS BIGINT) AS loose_total FROM x GROUP BY 1""")
def strict_sum_total(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.when(F.col("l_discount") < 0.08, F.col("l_quantity").cast("long")).alias("q"))
    return x.groupBy("match_id").agg(strict_sum(F.col("q")).alias("strict_total"), F.sum("q").alias("loose_total"))


@query(f"WITH {EVENTS} SELECT user_id, CAST(list_sort(list(value))[count(*) // 2 + 1] AS DOUBLE) AS median FROM ev GROUP BY 1")
def upper_median_value(spark, sf_dir):
    return upper_median(events(spark, sf_dir).select("user_id", F.col("value").cast("double").alias("median")), ["user_id"], "median")


@query(f"""WITH {EVENTS}, d AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM ev), b AS (SELECT user_id, max(day) + 1 AS expected FROM d GROUP BY 1)
SELECT b.user_id, expected, count(d.day) AS present, CAST(count(d.day) AS DOUBLE) / CAST(expected AS DOUBLE) AS coverage FROM b JOIN d USING (user_id) GROUP BY 1, 2""")
def expected_coverage(spark, sf_dir):
    d = events(spark, sf_dir).select("user_id", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")).distinct()
    expected = d.groupBy("user_id").agg((F.max("day") + 1).alias("expected")).withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.col("expected") - 1)))
    hits = expected.join(d.withColumn("hit", F.lit(1)), ["user_id", "day"], "left")
    return hits.groupBy("user_id", "expected").agg(F.count("hit").alias("present")).withColumn("coverage", F.col("present").cast("double") / F.col("expected").cast("double"))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2), w AS (SELECT * FROM (VALUES ('view', 3, 4), ('click', 2, 3), ('purchase', 5, 2)) AS w(event_type, weight, expected)),
u AS (SELECT DISTINCT user_id FROM ev) SELECT u.user_id, CAST(sum(weight * least(1.0, CAST(coalesce(n, 0) AS DOUBLE) / expected)) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS completeness
FROM u CROSS JOIN w LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = w.event_type GROUP BY 1""")
def weighted_completeness(spark, sf_dir):
    rules = {"view": (3, 4), "click": (2, 3), "purchase": (5, 2)}  # fixed values: weight, expected
    e = events(spark, sf_dir).groupBy("user_id").agg(*[count_where(F.col("event_type") == k).alias(k) for k in rules])
    total = sum(w for w, _ in rules.values())
    terms = [F.lit(w) * F.least(F.lit(1.0), F.col(k).cast("double") / x) for k, (w, x) in rules.items()]
    return e.select("user_id", (sum(terms[1:], terms[0]) / total).alias("completeness"))


def pair_results(spark, sf_dir):
    s = season(spark, sf_dir).select("match_id", "player_id", "result", "goals")
    return unordered_pairs(s, "match_id", "player_id", ["result"]).groupBy("a", "b").agg(F.count("*").alias("gp"), count_where(F.col("result") == "WIN").alias("wins"), count_where(F.col("result") != "DNF").alias("decided"))


PAIRS = f"{SEASON}, pairs AS (SELECT x.player_id AS a, y.player_id AS b, count(*) AS gp, count_if(x.result = 'WIN') AS wins, count_if(x.result <> 'DNF') AS decided FROM season x JOIN season y ON x.match_id = y.match_id AND x.player_id < y.player_id GROUP BY 1, 2)"


@query(f"""WITH {PAIRS}, q AS (SELECT *, wins * 1000 // decided AS per_mille FROM pairs WHERE gp >= 3 AND decided > 0)
SELECT member, CAST(sum(per_mille) AS DOUBLE) / count(*) AS mean, count(*) AS pairs FROM (SELECT a AS member, per_mille FROM q UNION ALL SELECT b, per_mille FROM q) GROUP BY 1""")
def pair_member_avg(spark, sf_dir):
    q = pair_results(spark, sf_dir).filter("gp >= 3 AND decided > 0").withColumn("per_mille", F.expr("wins * 1000 DIV decided"))
    return member_means(q, "a", "b", "per_mille")


@query(f"""WITH {EVENTS}, t AS (SELECT DISTINCT event_type FROM ev), d AS (SELECT unnest(range(0, 3)) AS day),
c AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_type, count(*) AS n FROM ev WHERE value > 50 GROUP BY 1, 2)
SELECT d.day, t.event_type, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN c ON c.day = d.day AND c.event_type = t.event_type""")
def faceted_counts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    facets = e.select("event_type").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    counts = e.filter("value > 50").groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return facets.join(counts, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {EVENTS} SELECT user_id, CAST(count_if(value < 40 AND event_type <> 'error') AS DOUBLE) / nullif(count_if(event_type <> 'error'), 0) AS direct_share FROM ev GROUP BY 1")
def share_direct(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return events(spark, sf_dir).groupBy("user_id").agg((F.count_if(ok & (F.col("value") < 40)).cast("double") / F.nullif(F.count_if(ok), F.lit(0).cast("long"))).alias("direct_share"))


@query("""WITH d AS (SELECT source, CASE WHEN lang IS NOT NULL THEN 1.0 ELSE 0.0 END AS f1, CASE WHEN lang = 'en' THEN CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END END AS f2 FROM documents),
g AS (SELECT source, avg(f1) AS b1, avg(f2) AS b2 FROM d GROUP BY 1) SELECT source, (b1 + coalesce(b2, 0)) / (1 + CASE WHEN b2 IS NULL THEN 0 ELSE 1 END) AS overall FROM g""")
def completeness_mean(spark, sf_dir):
    flag = lambda c: c.cast("double")
    g = read(spark, sf_dir, "documents").groupBy("source").agg(F.avg(flag(F.col("lang").isNotNull().cast("int"))).alias("b1"), F.avg(F.when(F.col("lang") == "en", flag((F.col("n_chars") > 500).cast("int")))).alias("b2"))
    return g.select("source", ((F.col("b1") + F.coalesce("b2", F.lit(0.0))) / (1 + F.col("b2").isNotNull().cast("int"))).alias("overall"))


@query(f"""WITH {MATCHES}, r AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY opponent_id ORDER BY played_at DESC, match_id DESC) <= 10)
SELECT opponent_id, count_if(result = 'WIN') AS w, count_if(result IN ('LOSS', 'DNF')) AS l, count_if(result = 'OTL') AS o FROM r GROUP BY 1""")
def last_ten_record(spark, sf_dir):
    w = Window.partitionBy("opponent_id").orderBy(F.desc("played_at"), F.desc("match_id"))
    r = matches(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n <= 10")
    return r.groupBy("opponent_id").agg(count_where(F.col("result") == "WIN").alias("w"), count_where(F.col("result").isin("LOSS", "DNF")).alias("l"), count_where(F.col("result") == "OTL").alias("o"))


@query("SELECT p_brand || '|' || p_type AS build, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY 1")
def first_seen_count(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.concat_ws("|", "p_brand", "p_type").alias("build")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_seen"))


@query("""WITH p AS (SELECT lang, toxic = 1 AS truth, n_chars > 1500 AS guess FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count_if(truth AND guess) AS tp, count_if(NOT truth AND guess) AS fp, count_if(truth AND NOT guess) AS fn, count(*) AS n FROM p GROUP BY 1)
SELECT lang, n, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS prec, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0) AS f1, CAST(n - fp - fn AS DOUBLE) / n AS accuracy FROM c""")
def field_scoring(spark, sf_dir):
    p = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    t, g = F.col("toxic") == 1, F.col("n_chars") > 1500
    c = p.groupBy("lang").agg(count_where(t & g).alias("tp"), count_where(~t & g).alias("fp"), count_where(t & ~g).alias("fn"), F.count("*").alias("n"))
    over = lambda a, b: a.cast("double") / F.nullif(b, F.lit(0).cast("long"))
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select("lang", "n", over(tp, tp + fp).alias("prec"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(n - fp - fn, n).alias("accuracy"))
