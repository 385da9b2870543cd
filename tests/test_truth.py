"""The truth layer by hand: tolerance, missing sides, matches that can't be graded."""

from statforge.operators.truth import PLAYER, TEAM, truth_diffs, truth_layer

TEAMS = "match_id long, " + ", ".join(f"{f} long" for f in TEAM)
TRUE = "match_id long, player_id long, goals long, assists long, saves long, save_pct double"


def test_truth(spark):
    true_teams = spark.createDataFrame([(1, 3, 2, 20, 21, 5, 6), (2, 1, 1, None, None, None, None), (4, 0, 0, 1, 1, 1, 1)], TEAMS)
    teams = spark.createDataFrame([(1, 3, 1, None, 21, 5, 6), (2, None, None, 4, 4, 4, 4), (3, 1, 1, 1, 1, 1, 1)], TEAMS)
    true_players = spark.createDataFrame([(1, 7, 1, 0, 0, 90.0), (3, 7, 1, 0, 0, 90.0)], TRUE)
    players = spark.createDataFrame([(1, 7, "a", 2, 0, None, 90.009), (1, 8, "b", 1, 1, 1, 1.0), (1, None, "c", 1, 1, 1, 1.0), (3, 7, "a", 1, 0, 0, 90.0)], "match_id long, player_id long, tag string, goals long, assists long, saves long, save_pct double")
    diffs = truth_diffs(teams, players, true_teams, true_players)
    assert set(diffs.select("match_id", "scope", "field", "matched").collect()) == {
        *[(1, "team", f, f != "goals_against") for f in TEAM if f != "shots_for"], (1, "player:a", "goals", False), (1, "player:a", "assists", True), (1, "player:a", "save_pct", True)
    }
    assert len(PLAYER) == 4
    matches = spark.createDataFrame([(m,) for m in range(1, 5)], "match_id long")
    finals = spark.createDataFrame([(1, 3, 2), (2, 1, 9), (3, 1, 1), (4, 0, None)], "match_id long, goals_for long, goals_against long")
    got = {r.match_id: (r.gradable, r.fields, r.matched, r.score, r.passed, r.final_accuracy, r.gate) for r in truth_layer(matches, diffs, true_teams, finals).collect()}
    assert got == {1: (True, 8, 6, 0.75, False, 1.0, "PASS"), 2: (True, 0, 0, None, None, 0.5, "HOLD"), 3: (False, 0, 0, None, None, None, "OPERATOR_CONFIRM"), 4: (True, 0, 0, None, None, None, "HOLD")}
    assert truth_layer(matches.limit(0), diffs, true_teams, finals).isEmpty()
