"""Operators on hand-worked cases."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statforge.functions.clock import elapsed, mm_ss, repaired, seconds_of
from statforge.functions.nulls import either_sum, ratio, strict_sum, weighted_mean, zero_as_null
from statforge.functions.text import fuzzy_contains, similarity, snapshot_name
from statforge.operators.joins import neighbours
from statforge.operators.decoding import viterbi
from statforge.operators.matching import greedy_pairs
from statforge.operators.segments import segments_of
from statforge.operators.sequences import reels_of
from statforge.operators.windows import ordinal
from statforge.plans import registry
from statforge.sources.tables import dated_files, guarded, history, merged, new_rows, read_manifest, replace_partitions, upserted
from statforge.streaming.ingest import start


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_nulls(spark):
    lit = F.lit
    assert one(spark, ratio(lit(1), lit(8), 100)) == 12.5
    assert one(spark, ratio(lit(1), lit(0))) is None
    assert one(spark, either_sum(lit(None).cast("int"), lit(2))) == 2
    assert one(spark, either_sum(lit(None).cast("int"), lit(None).cast("int"))) is None
    assert one(spark, zero_as_null(lit(0))) is None
    df = spark.createDataFrame([(1, 1, None), (1, 2, 3), (2, 2, 5)], "g int, w int, v int")
    got = {r.g: (r.s, r.m) for r in df.groupBy("g").agg(strict_sum(F.col("v")).alias("s"), weighted_mean(F.col("v"), F.col("w")).alias("m")).collect()}
    assert got == {1: (None, 3.0), 2: (5, 5.0)}


def test_text_and_clock(spark):
    lit = F.lit
    assert one(spark, snapshot_name(lit("-. Jo Doe (C) x"))) == "Jo Doe"
    assert one(spark, similarity(lit("abcd"), lit("abxd"))) == 0.75
    assert one(spark, fuzzy_contains(lit("xx hallo yy"), lit("hello"), 1)) is True
    assert one(spark, fuzzy_contains(lit("abc"), lit("zzzzz"), 1)) is False
    assert one(spark, seconds_of(lit("12:34"))) == 754 and one(spark, seconds_of(lit("x"))) is None
    assert one(spark, elapsed(lit("19:30"))) == 30 and one(spark, elapsed(lit("5:61"))) is None
    assert one(spark, mm_ss(lit(65))) == "01:05" and one(spark, repaired(lit("I2:OB"))) == "12:08"


def test_segments():
    s = list("aaabaaacccb") + ["d"] * 4
    t = [float(i) for i in range(len(s))]
    # the second c closes a and is tried as an opener, the first is not tried again
    assert segments_of(s, t, shortest=2.0) == [("a", 0, 6), ("d", 11, 14)]
    assert segments_of(s, t, shortest=5.0) == [("a", 0, 6)]
    assert segments_of([], []) == [] and segments_of(list("ababab"), t) == []


def test_reels():
    assert reels_of(list("OOgPgOgP"), {"O"}, {"P"}) == [0, 0, 0, 0, 1, 2, 2, 2]
    assert reels_of([], {"O"}, {"P"}) == []


def test_viterbi():
    hit = np.log([[0.8, 0.2], [0.2, 0.8]])
    move = np.log([[0.9, 0.1], [0.1, 0.9]])
    seen = [0, 0, 1, 0, 0, 1, 1, 1, 1]
    assert viterbi(hit[seen], move, np.log([0.5, 0.5])) == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_greedy():
    assert greedy_pairs([(1.0, 1, 1), (3.0, 1, 2), (2.0, 2, 2), (0.5, 2, 1)]) == [(1, 2, 3.0), (2, 1, 0.5)]


def test_time_ties(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 1, 20), (3, 1, 20), (4, 1, 30)], "id int, g int, ts int")
    assert {r.id: (r.previous_id, r.next_id) for r in neighbours(df, ["g"], "ts", "id").collect()} == {1: (None, 2), 2: (1, 4), 3: (1, 4), 4: (2, None)}
    assert {r.id: r.n for r in df.select("id", ordinal(["g"], "ts").alias("n")).collect()} == {1: 1, 2: 3, 3: 3, 4: 4}


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None, 1), (2, None, "manual", 1)], "id int, v string, origin string, version int")
    new = spark.createDataFrame([(2, "n", "ocr", 2), (3, "c", "ocr", 2), (3, "c", "ocr", 2)], old.schema)
    assert [r.id for r in new_rows(new, old, ["id"]).collect()] == [3]
    assert {r.id: r.v for r in upserted(old, new, ["id"], "version").collect()} == {1: "a", 2: "n", 3: "c"}
    assert {r.id: (r.v, r.version) for r in merged(old, new.distinct(), ["id"]).collect()} == {1: ("a", 1), 2: ("n", 1), 3: ("c", 2)}
    assert {r.id: r.v for r in guarded(old, spark.createDataFrame([(1, "z"), (2, "z")], "id int, v string"), "id", "v", "origin").collect()} == {1: "z", 2: None}
    h = history(spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3)], "id int, tag string, ts int"), "id", "tag", "ts").collect()
    assert sorted((r.tag, r.seen_from, r.seen_until) for r in h) == [("x", 1, 3), ("y", 3, None)]
    path = str(tmp_path / "t")
    replace_partitions(old.select("id", "v"), path, ["id"])
    replace_partitions(spark.createDataFrame([("q", 1)], "v string, id int"), path, ["id"])
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "q", 2: None}


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("title_slug,gamertag,game_mode,position_scope,role_group,asset_path\n t1 , Bob ,,all,skater,x.png\n")
    r = read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r.title_slug, r.gamertag, r.game_mode) == ("t1", "Bob", "")
    videos = tmp_path / "v"
    videos.mkdir()
    for d in ("2024-01-02", "2024-03-04"):
        (videos / f"clip {d} 10.mp4").write_text("x")
    assert [str(x.day) for x in dated_files(spark, str(videos), "2024-02-01").collect()] == ["2024-03-04"]


@pytest.mark.parametrize("repeat", [1, 2])
def test_streaming(spark, tmp_path, repeat):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = [(1, 1, '{"result":"WIN","score":"3"}'), (1, 2, '{"result":"LOSS","score":""}'), (2, 3, "broken"), (2, 4, '{"result":"WIN","score":"x"}')]
    for i in range(repeat):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("title", "match_id", "payload"), r, strict=True))) for r in rows))
        start(spark, str(source), root).awaitTermination()
    totals = {r.title: (r.gp, r.score, r.wins) for r in spark.read.parquet(f"{root}/totals").collect()}
    assert totals == {1: (2, 3, 1)}
    assert spark.read.parquet(f"{root}/raw").count() == 4
    assert {r.match_id: r.problem for r in spark.read.parquet(f"{root}/quarantine").collect()} == {3: "no payload", 4: "score is no number"}


def test_resolve_cascade_against_all_pairs(spark):
    """Short alphabets, so that names of one letter meet many tags and equal tags occur."""
    from statforge.operators.joins import VIA, resolve_cascade

    r = random.Random(21)
    word = lambda most: "".join(r.choice("ab0") for _ in range(r.randint(0, most)))
    players = [(i, word(7), r.random() < 0.8) for i in range(40)] + [(90, None, True), (91, "", True)]
    history = [(100 + i, word(5), r.random() < 0.7) for i in range(25)]
    aliases = [(200 + i, word(4)) for i in range(4)]
    probes = [(i, word(9)) for i in range(150)] + [(500, None), (501, "..")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {x.id: (x.player_id, x.via) for x in resolve_cascade(frame(probes, "id long, snapshot string"), frame(players, "player_id long, gamertag string, is_active boolean"), frame(history, "player_id long, gamertag string, in_use boolean"), frame(aliases, "player_id long, alias string")).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        return a == b or any(a[:i] + a[i + 1 :] in (b, b[:i] + b[i + 1 :]) for i in range(len(a))) or any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    def resolve(name):
        for step, rows in enumerate([[p[:2] for p in players], [h[:2] for h in history if h[2]], aliases]):
            equal = [i for i, t in rows if name and t and t == name]
            if equal:
                return min(equal), VIA[step]
        active = [(i, t) for i, t, on in players if on and t]
        for step, test in ((3, lambda t: t in name or name in t), (4, lambda t: near(name, t))):
            hits = {i for i, t in active if name and test(t)}
            if len(hits) == 1:
                return hits.pop(), VIA[step]
        return None, VIA[-1]

    assert got == {i: resolve(s or "") if s != ".." else (None, VIA[-1]) for i, s in probes}
    assert {v for _, v in got.values()} == set(VIA)


def test_recorded_at_in_both_halves_of_a_year(spark):
    from statforge.operators.screens import recorded_at

    names = ["clip 2024-01-15 12-00-00.mp4", "clip 2024-07-15 12-00-00.mp4", "clip 2024-11-03 01-30-00.mp4", "clip 2024-03-10 02-30-00.mp4", "clip 2024-11-03 03-00-00.mp4", "other.mp4", None]
    got = [(r.recorded_at, r.in_change) for r in recorded_at(spark.createDataFrame([(n,) for n in names], "file string").coalesce(1), "file", "America/New_York").collect()]
    assert got[0] == (1705338000, False) and got[1] == (1721059200, False)
    assert [x[1] for x in got[2:5]] == [True, True, False] and got[4][0] == 1730620800
    assert got[5:] == [(None, False), (None, False)]


def test_array_sum_avg_rounds_as_sql(spark, tmp_path):
    """Halves of the single-precision product go away from zero."""
    import duckdb

    from statforge.plans import registry

    rows = [(i, [float(np.float32((k + 0.5) / 1000)) for k in range(8 * i, 8 * i + 8)], i % 2) for i in range(-40, 40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, registry.QUERIES["array_sum_avg"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.SQL["array_sum_avg"]).fetchall())


def test_cascade_broadcasts_nothing(spark, tmp_path):
    """Exploded stretches of names are many times the size that is estimated, so no side may be sent to the driver."""
    from statforge.operators.joins import resolve_cascade

    tables = {
        "probes": spark.createDataFrame([(1, "Amber."), (2, "mbe"), (3, "quart"), (4, "zz")], "id long, snapshot string"),
        "players": spark.createDataFrame([(5, "amber", True), (6, "Quarz", True)], "player_id long, gamertag string, is_active boolean"),
        "history": spark.createDataFrame([(5, "old", True)], "player_id long, gamertag string, in_use boolean"),
        "aliases": spark.createDataFrame([(6, "q")], "player_id long, alias string"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}")
    found = resolve_cascade(*[spark.read.parquet(f"{tmp_path}/{name}") for name in tables])
    assert sorted(map(tuple, found.collect())) == [(1, 5, "gamertag_exact"), (2, 5, "gamertag_substring"), (3, 6, "gamertag_levenshtein"), (4, None, "unresolved")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_persona_meets_each_name_once(spark, monkeypatch):
    from statforge.operators import joins

    asked, meet = [], joins.within_one_edit
    monkeypatch.setattr(joins, "within_one_edit", lambda left, *rest: asked.append(left.count()) or meet(left, *rest))
    probes = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "Amber!").otherwise("mber").alias("snapshot"))
    got = joins.resolve_persona(probes, spark.createDataFrame([("amber", "Amber")], "alias string, canonical string"))
    assert {tuple(r) for r in got.select("canonical", "via").distinct().collect()} == {("Amber", "exact_alias"), ("Amber", "fuzzy_alias")}
    assert got.count() == 50 and asked == [2]


SMALL = "/root/testdata/sf0.001"


def optimized(spark, name):
    return registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pairs_min_gp", "pair_member_avg", "with_without_splits", "three_stars", "event_roles"])
def test_lines_are_dealt_by_rows(spark, monkeypatch, name):
    """Tasks take so many of the table's 6,000 lines each, whatever size in bytes partitions are joined up to."""
    from statforge.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 200, raising=False)
    assert re.search(r"RepartitionByExpression \[l_orderkey#\d+L?\], 30\b", optimized(spark, name))


def test_line_ups_are_made_once(spark):
    """Stars of skaters and goalies come from one reading of the lines; orders are read for the units and their total alone."""
    assert optimized(spark, "three_stars").count("Relation [") == 1
    assert optimized(spark, "with_without_splits").count("Relation [o_orderkey") == 2


def test_palettes_are_dealt_and_fit_as_step_by_step(spark, monkeypatch):
    """Clubs are dealt to many tasks; chroma falls no further than the first step that fits."""
    from statforge.functions import colors as C
    from statforge.plans import truth_queries

    monkeypatch.setattr(truth_queries, "CLUBS", 20, raising=False)
    assert registry.QUERIES["club_palette"](spark, SMALL).rdd.getNumPartitions() == 10
    lch = spark.createDataFrame([(0.62, 0.01, 29.0), (0.62, 0.14, 200.0), (0.62, 0.4, 130.0), (0.99, 0.3, 29.0), (1.2, 0.1, 29.0), (None, 0.1, 29.0)], "l double, c double, h double")
    steps = [C.from_oklch(F.col("l"), F.lit(0.0) if i == C.STEPS else F.col("c") * F.pow(F.lit(C.SHRINK), F.lit(i)), F.col("h")) for i in range(C.STEPS + 1)]
    rows = lch.select(C.in_gamut(F.struct("l", "c", "h")).alias("got"), F.array(*steps).alias("steps")).collect()
    for r in rows[:-1]:
        assert r.got == next((s for s in r.steps if all(-0.5 <= x <= 255.5 for x in s)), r.steps[-1])


#: Customers of a large table whose slope or intercept is a half of its last digit: key and total of each order.
HALVES = {
    9873: [(3892, 100065.64), (3973, 496678.27), (5086, 328613.37), (16906, 96240.21), (19878, 248773.38), (59229, 152566.11), (98561, 10194.48), (99332, 462445.45), (142064, 428859.21)],
    13040: [(16208, 343333.55), (53924, 96674.18), (78548, 58055.84), (86836, 67579.96), (119148, 462921.09)],
    3425: [(83219, 73852.79), (115572, 195310.43), (120804, 486661.36), (121523, 169827.38), (129385, 446764.71), (131854, 24924.21), (156532, 251399.57), (179534, 313491.26)],
}
#: (key within 100, total) of customers with one place only, a level line, missing numbers, two places, a slope that is rounded to zero, slopes of 1.005, 8.575 and 2.675.
ODD = [[(5, 100.0), (5, 200.0), (5, 300.0)], [(1, 100.0), (2, 100.0), (3, 100.0)], [(1, None), (2, None), (3, None)], [(1, 100.0), (2, None), (3, None)], [(1, 100.0), (2, 250.0), (3, None)], [(1, 0.001), (2, 0.0), (4, 0.0)], [(1, 1.0), (2, 2.0)], [(1, 1e300), (2, -1e307), (7, 1e307)], [(None, 1.0), (2, 2.0), (4, 3.5), (9, 7.25)], *[[(0, 0.0), (2, y), (4, 2 * y)] for y in (2.01, 17.15, 5.35)]]


def test_axis_mapping_as_in_sql(spark, tmp_path):
    """Lines of any order of rows are those of one reading in order, halves and customers without a line included."""
    import duckdb

    rows = [(k, c, v) for c, orders in HALVES.items() for k, v in orders]
    rows += [(None if x is None else 1_000_000 + 1000 * c + 100 * i + x, -c, v) for c, orders in enumerate(ODD) for i, (x, v) in enumerate(orders)]
    table = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    table.coalesce(1).sortWithinPartitions("o_orderkey").write.parquet(f"{tmp_path}/in_order")
    for i in range(3):
        part = table.filter((F.coalesce("o_orderkey", F.lit(0)) / 100).cast("long") % 3 == i).coalesce(1).sortWithinPartitions(F.desc("o_orderkey"))
        part.write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/in_order/*.parquet'")
    want = con.execute(registry.SQL["axis_mapping"]).fetchall()
    got = registry.QUERIES["axis_mapping"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == len(HALVES) + len(ODD) - 1
