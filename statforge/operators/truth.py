"""The truth layer: what was read of a match, held field by field against what its payload says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verdicts import PASSES, final_gate

#: Fields compared, and by how much shares of saves may differ.
TEAM = ["goals_for", "goals_against", "shots_for", "shots_against", "faceoffs_for", "faceoffs_against"]
PLAYER = ["goals", "assists", "saves", "save_pct"]
TOLERANCE = {"save_pct": 0.01}


def _compared(rows: DataFrame, scope: Column, fields: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r_{f}").cast("double").alias("read"), F.col(f"t_{f}").cast("double").alias("truth"), F.lit(TOLERANCE.get(f, 0.0)).alias("within")) for f in fields])
    cells = rows.select("match_id", scope.alias("scope"), F.inline(cells)).filter("read IS NOT NULL AND truth IS NOT NULL")
    return cells.select("match_id", "scope", "field", "read", "truth", (F.abs(F.col("read") - F.col("truth")) <= F.col("within")).alias("matched"))


def _named(df: DataFrame, keys: list[str], fields: list[str], mark: str) -> DataFrame:
    return df.select(*keys, *[F.col(f).alias(f"{mark}_{f}") for f in fields])


def truth_diffs(teams: DataFrame, players: DataFrame, true_teams: DataFrame, true_players: DataFrame) -> DataFrame:
    """match_id, scope (team or player:<tag>), field, read, truth and matched, wherever both sides
    have a value. teams: match_id and ``TEAM``, a row a match; players: match_id, tag, player_id (null:
    not resolved, left out) and ``PLAYER``; the true ones without tag, a row a player."""
    of_teams = _named(teams, ["match_id"], TEAM, "r").join(_named(true_teams, ["match_id"], TEAM, "t"), "match_id")
    keys = ["match_id", "player_id"]
    of_players = _named(players, [*keys, "tag"], PLAYER, "r").join(_named(true_players, keys, PLAYER, "t"), keys)
    # players of a match without a true team total are not graded
    of_players = of_players.join(true_teams.select("match_id").distinct(), "match_id", "left_semi")
    return _compared(of_teams, F.lit("team"), TEAM).unionByName(_compared(of_players, F.concat(F.lit("player:"), F.col("tag")), PLAYER))


def truth_layer(matches: DataFrame, diffs: DataFrame, true_teams: DataFrame, finals: DataFrame) -> DataFrame:
    """match_id, gradable, fields, matched, score, passed, final_accuracy and gate of every match
    (match_id). Without true totals a match can't be graded; without a field on both sides it has
    no score. final_accuracy is the share of two goals of the final as read (finals: match_id,
    goals_for, goals_against), null unless both were; the gate goes by it alone."""
    graded = diffs.groupBy("match_id").agg(F.count("*").alias("fields"), F.count_if("matched").alias("matched"))
    truth = true_teams.select("match_id", F.col("goals_for").alias("t_for"), F.col("goals_against").alias("t_against"), F.lit(True).alias("gradable"))
    rows = matches.select("match_id").join(graded, "match_id", "left").join(truth, "match_id", "left").join(finals.select("match_id", "goals_for", "goals_against"), "match_id", "left")
    gradable = F.coalesce("gradable", F.lit(False))
    fields, matched = F.when(gradable, F.coalesce("fields", F.lit(0))).otherwise(0), F.when(gradable, F.coalesce("matched", F.lit(0))).otherwise(0)
    score = F.when(fields > 0, matched / fields)
    hit = lambda side: F.coalesce((F.col(f"goals_{side}") == F.col(f"t_{side}")).cast("int"), F.lit(0))
    final = F.when(gradable & F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull(), (hit("for") + hit("against")) / 2.0)
    return rows.select(
        "match_id", gradable.alias("gradable"), fields.cast("long").alias("fields"), matched.cast("long").alias("matched"), score.alias("score"), (score >= PASSES["truth"]).alias("passed"), final.cast("double").alias("final_accuracy"),
        final_gate(final, gradable).alias("gate"),
    )
