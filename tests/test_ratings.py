"""Scores, possession, completeness and zones against worked cases."""

import pytest
from pyspark.sql import functions as F

from statforge.operators.ratings import ACTIVITY, completeness, possession, rated, zone_totals

FIELDS = [*ACTIVITY["skater"], *ACTIVITY["goalie"]]


def players(spark, *rows):
    schema = "is_goalie boolean, side string, winner string, " + ", ".join(f"{f} int" for f in FIELDS)
    return spark.createDataFrame([(g, "for", w, *[c.get(f) for f in FIELDS]) for g, w, c in rows], schema)


@pytest.mark.parametrize(
    ("goalie", "winner", "counters", "score", "active"),
    [
        (False, "for", {"goals": 2, "assists": 1}, 8 + 3.25 + 1, True),
        (False, "against", {"takeaways": 2, "interceptions": 1, "blocked_shots": 1, "penalties_drawn": 1}, 1.1 + 0.45 + 0.45 + 0.4, True),
        (False, None, {"giveaways": 2, "pim": 4, "shots": 5, "hits": 1}, -0.9 - 1.2 + 0.6 + 0.08, True),
        (False, None, {"plus_minus": -1, "faceoff_wins": 3, "faceoff_losses": 1}, -0.2 + 0.16, True),
        (False, "for", {"saves": 9}, 1.0, False),
        (True, None, {"saves": 9, "shots_against": 10, "goals_against": 1}, 1.8 + 13.5 - 0.8, True),
        (True, "for", {"desperation_saves": 1, "breakaway_saves": 1, "penalty_saves": 1, "poke_checks": 2}, 0.5 + 0.8 + 0.8 + 0.3 + 1, True),
        (True, None, {"goals": 3}, 0.0, False),
        (None, None, {}, 0.0, False),
    ],
)
def test_scores(spark, goalie, winner, counters, score, active):
    r = rated(players(spark, (goalie, winner, counters))).first()
    assert r.score == pytest.approx(score) and r.took_part is active
    assert sum(p.points for p in r.parts) == pytest.approx(score)
    assert len(r.parts) == (7 if goalie else 12) + (winner == "for")


def test_possession(spark):
    schema = "id int, shots_for int, shots_against int, hits_for int, hits_against int, attack_for int, attack_against int, faceoff_pct double, read_shots_for int, read_shots_against int"
    rows = [
        (1, 6, 4, 1, 4, 200, 100, 60.0, None, None),  # 0.4 * 0.6 + 0.3 * 2/3 + 0.2 * 0.6 + 0.1 * 0.2
        (2, 6, 4, 1, 4, 200, 100, None, None, None),
        (3, 6, 4, 1, 4, 0, 0, 60.0, None, None),
        (4, 6, 4, 1, 4, None, 9, None, None, None),
        (5, 0, 0, 0, 0, 200, 100, 50.0, None, None),
        (6, 0, 0, 0, 0, None, None, None, 3, 1),  # hits unknown: one half
    ]
    got = {r.id: (r.known, r.edge, r.edge_for, r.edge_against) for r in possession(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("attack+faceoffs", 58.0, 58, 42), 2: ("attack", 56.3, 56, 44), 3: ("faceoffs", 54.0, 54, 46), 4: ("", 48.0, 48, 52), 5: ("attack+faceoffs", None, None, None), 6: ("", 67.5, 68, 32)}
    assert possession(spark.createDataFrame([], schema)).count() == 0


def test_completeness_without_traits(spark):
    schema = "team int, identity array<string>, build string, bio array<string>, attributes int, traits array<struct<name:string,tier:string>>"
    rows = [(1, ["a", None], None, ["x", "y"], 3, None), (1, ["a", "b"], "b", [None, None], None, []), (2, ["a"], "b", ["x"], 1, [("n", None), (None, "Elite")])]
    got = {r.team: r for r in completeness(spark.createDataFrame(rows, schema), ["team"]).collect()}
    assert (got[1].identity, got[1].build, got[1].bio, got[1].attribute, got[1].trait, got[1].tier, got[1].overall) == (0.75, 0.5, 0.5, 0.5, None, None, 0.5625)
    assert (got[2].trait, got[2].tier, got[2].overall) == (0.5, 0.5, pytest.approx(5 / 6))


def test_zones(spark):
    df = spark.createDataFrame([(1, [1, 2, None]), (1, [3]), (2, None)], "g int, z array<int>")
    got = {r.g: (r.n, r.z_sum, r.z_mean) for r in zone_totals(df, ["g"], {"z": 3}).collect()}
    assert got == {1: (2, [4, 2, 0], [2.0, 1.0, 0.0]), 2: (1, [0, 0, 0], [0.0, 0.0, 0.0])}
    nobody = zone_totals(df.filter("g > 9"), [], {"z": 2}).first()
    assert (nobody.n, nobody.z_sum, nobody.z_mean) == (0, [0, 0], [0.0, 0.0])


def test_scores_of_nobody(spark):
    assert rated(players(spark).filter(F.lit(True))).count() == 0
