"""Lineup operators on hand-worked cases."""

import pandas as pd
from pyspark.sql import functions as F

from statforge.operators.joins import bound_alone, far_from, lineup_gate
from statforge.operators.lineups import anchored, captains, closed_vocabulary, filled, next_older


def test_gate(spark):
    actors = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, None)], "m int, p int")
    lineup = spark.createDataFrame([(1, 7), (1, 7), (3, 9), (2, None)], "m int, p int")
    got = {(r.m, r.p): r.gate for r in lineup_gate(actors, lineup, "m", "p").collect()}
    assert got == {(1, 7): "ok", (1, 8): "roster_mismatch", (2, 7): "empty_lineup_passthrough", (3, None): "roster_mismatch"}


def test_elimination_and_distance(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k int, a int")
    b = spark.createDataFrame([(1, 11), (2, 22)], "k int, b int")
    assert [tuple(r) for r in bound_alone(a, b, "k", "a", "b").collect()] == [(1, 10, 11)]
    x = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, None), (2, 0.0)], "g int, v double")
    near = spark.createDataFrame([(1, 3.0), (1, None)], "g int, v double")
    assert sorted((r.g, r.v if r.v is not None else -1) for r in far_from(x, near, ["g"], "v", 3).collect()) == [(1, -1), (2, 0.0)]
    assert far_from(x.limit(0), near, ["g"], "v", 3).count() == 0


def test_choice(spark):
    rows = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "b", 9), (1, 3, "b", 9), (2, 4, None, None)], "g int, id int, tag string, c int")
    assert {r.g: r.anchor for r in anchored(rows, ["g"], "tag", "a", "c", "id").collect()} == {1: 1, 2: 4}
    assert {r.g: r.anchor for r in anchored(rows, ["g"], "tag", "z", "c", "id").collect()} == {1: 3, 2: 4}
    assert {r.g: (r.id, r.via) for r in captains(rows, ["g"], "c", "id", 6).collect()} == {1: (2, "voted"), 2: (4, "fallback")}
    assert {r.id: (r.older, r.older_tag) for r in next_older(rows, ["g"], "id", ["tag"]).collect()} == {1: (None, None), 2: (1, "a"), 3: (2, "b"), 4: (None, None)}


def test_vocabulary(spark):
    words = spark.createDataFrame([("cold",), ("bold",), ("zzzzzz",), (None,)], "w string")
    got = {r.w: (r.canonical, r.confidence) for r in words.select("w", *closed_vocabulary(F.col("w"), ["cold", "gold"], 1)).collect()}
    assert got == {"cold": ("cold", 1.0), "bold": ("cold", 0.5), "zzzzzz": (None, 0.0), None: (None, 0.0)}


def test_lines():
    scores = pd.DataFrame([("C", 1, 300), ("C", 2, 200), ("W", 1, 500), ("W", 3, 100)], columns=["lane", "who", "score"])
    assert filled(scores, "who", "lane")[:4] == [(1, "C", 1, False), (1, "W", 3, False), (2, "C", 2, False), (2, "W", 1, True)]
