"""Line-ups as shown: which snapshot speaks, what other frames add, worked by hand."""

import pytest
from pyspark.sql import functions as F

from statforge.functions.formats import handedness, height_text, level_parts
from statforge.operators.ladders import rekeyed
from statforge.operators.lineup_reads import fuller_build, lineup_slots, recovered_bio

SNAPSHOT = (
    "match_id long, id long, captured_at timestamp, gamertag string, player_id long, team_side string, ours array<string>, theirs array<string>, position string, build string, build_canonical string, number int, "
    "height string, weight int, handedness string, level string, platform string, is_captain boolean, is_cpu boolean, reviewed boolean"
)
TABLES = ["id long, place int, name string, tier string", "id long, key string, value long, delta long", "match_id long, id long, gamertag string, height string, weight string, handedness string, level string, build_canonical string", "match_id long, side string, who string, platform string"]


def shown(spark, snapshots, *tables):
    names = [c.split()[0] for c in SNAPSHOT.split(", ")]
    base = {"match_id": 1, "team_side": "for", "position": "C", "build": "b", "is_cpu": False, "reviewed": False, "gamertag": "Some One"}
    rows = [tuple((base | s).get(n) for n in names) for s in snapshots]
    frames = [spark.createDataFrame(list(t), schema) for t, schema in zip([*tables, *[()] * (4 - len(tables))], TABLES, strict=True)]
    return {(r.side, r.position): r for r in lineup_slots(spark.createDataFrame(rows, SNAPSHOT), *frames).collect()}


def test_which_snapshot_speaks(spark):
    got = shown(spark, [{"id": 1, "reviewed": True}, {"id": 2, "reviewed": True}, {"id": 3}, {"id": 4, "position": "G", "gamertag": "CPU"}, {"id": 5, "position": "LW", "gamertag": "m"}, {"id": 6, "position": "RW", "is_cpu": True}, {"id": 7, "position": "LD", "build": None}])
    assert {k: r.id for k, r in got.items()} == {("for", "C"): 2}
    # without a review: each player where they stood last, of two in a slot the one seen last
    got = shown(spark, [{"id": 1, "gamertag": "a a"}, {"id": 2, "gamertag": "b b"}, {"id": 3, "gamertag": "a a", "position": None}, {"id": 4, "gamertag": "c c", "position": "LW"}, {"id": 5, "gamertag": "c c", "position": "RW"}])
    assert {k: r.id for k, r in got.items()} == {("for", "C"): 1, ("for", "RW"): 5}


def test_sides(spark):
    lobby = {"team_side": None, "ours": ["one"], "theirs": ["two"]}
    got = shown(spark, [{"id": 1, "gamertag": "ONE", **lobby}, {"id": 2, "gamertag": "two", "player_id": 7, **lobby}, {"id": 3, "gamertag": "three", "position": "G", "team_side": None}, {"id": 4, "gamertag": "four", "player_id": 8, "team_side": None, "position": "G"}])
    assert {k: r.id for k, r in got.items()} == {("for", "C"): 1, ("against", "C"): 2, ("against", "G"): 3, ("for", "G"): 4}


def test_details(spark):
    views = [(1, i, "some.one", h, w, s, lv, b) for i, (h, w, s, lv, b) in enumerate([("6 '1", "601 lbs", "SHOOTS LEFT", "LVL 9", "Model - sniper"), ("6'1\"", "180", "left", "p2lvl9", "Model - sniper"), ("5'9", "180 lbs", "?", "p2lvl9", None)])]
    frames = [{"id": 1, "reviewed": True, "player_id": 5, "height": " ", "build_canonical": "sniper", "is_captain": True, "platform": "old"}, {"id": 2, "gamertag": "someone", "position": None}, {"id": 3, "gamertag": "Other", "position": "LW", "is_captain": True}]
    got = shown(spark, frames, [(1, 0, "x", "null"), (2, 0, "y", None), (1, 1, "z", "Elite"), (2, 1, "w", "gold")], [(1, "pace", 1, 1), (2, "pace", 2, None), (2, "shot", None, 3)], views, [(1, "for", "5", "new")])
    r = got["for", "C"]
    assert (r.height, r.weight, r.handedness, r.prestige, r.level, r.build_canonical, r.platform) == ("6'1\"", 180, "Left", 2, 9, "Model - sniper", "new")
    assert [tuple(t) for t in r.traits] == [(0, "y", None), (1, "z", "Elite")] and [tuple(a) for a in r.attributes] == [("pace", 2, None)]
    assert (r.is_captain, got["for", "LW"].is_captain) == (True, False)


def test_nothing(spark):
    assert shown(spark, []) == {}
    views = spark.createDataFrame([(1, 1, "--", "6'1", None, None, None, None), (1, 2, None, "6'1", None, None, None, None), (1, 3, "a", "6'1", None, None, None, None)], TABLES[2])
    assert recovered_bio(views).count() == 0


@pytest.mark.parametrize(("stored", "seen", "want"), [(None, "b", "b"), ("b", None, "b"), ("b", "m - b", "m - b"), ("b", "m - c", "b"), ("k - b", "m - b", "k - b"), (None, None, None)])
def test_builds(spark, stored, seen, want):
    df = spark.createDataFrame([(stored, seen)], "a string, b string")
    assert df.select(fuller_build(F.col("a"), F.col("b"))).first()[0] == want


def test_formats(spark):
    df = spark.createDataFrame([("Shoots LEFT", "6 ' 11", "P12 LVL 3"), ("right", "511", "lvl 8"), (None, None, None), ("", "", "x")], "h string, t string, l string")
    got = df.select(handedness(F.col("h")), height_text(F.col("t")), *level_parts(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("Left", "6'11\"", 12, 3), ("Right", None, None, 8), (None, None, None, None), (None, None, None, None)]


def test_ladder(spark):
    lines = "match_id long, side string, id long, position string, player_id long, gamertag string, build string"
    stats = "match_id long, side string, id long, player_id long, gamertag string, position string"
    played = [(1, "for", 1, 7, "one", "center"), (1, "for", 2, None, "two", "leftWing"), (1, "for", 3, None, "two", "goalie"), (1, "for", 4, 9, "nine", "bench"), (1, "against", 5, 7, "far", "defenseMen")]
    rows = [
        (1, "for", 1, "LD", 7, "misread", None), (1, "for", 2, "C", None, "nobody", "b"),  # a known player outranks a label
        (1, "for", 3, "G", None, "T-W-O", None), (1, "for", 4, "RD", None, "two", "b"),  # more detail
        (1, "for", 5, "C", 9, "nine", "b"), (1, "for", 6, "RW", None, None, None), (1, "for", 8, "RW", None, "x", None), (1, "for", 7, "RD", None, "who", "b"),  # no place; by label, the smaller id; no place
        (1, "against", 9, "LW", 7, "other", None), (2, "for", 10, "RD", None, "two", None),
    ]
    make = spark.createDataFrame
    got = rekeyed(make(rows, lines), make(played, stats), ["build"], F.col("match_id") == 1)
    assert got.columns == [c.split()[0] for c in lines.split(", ")]
    assert {(r.match_id, r.side, r.position): r.id for r in got.collect()} == {(1, "for", "C"): 1, (1, "for", "W"): 4, (1, "for", "D"): 6, (1, "against", "W"): 9, (2, "for", "RD"): 10}
    assert rekeyed(make([], lines), make([], stats), ["build"], F.col("match_id") == 1).count() == 0
