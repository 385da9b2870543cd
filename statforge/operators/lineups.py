"""Lineups: anchors, captains, vocabularies, provenance and depth charts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 4


def captains(rows: DataFrame, by: list[str], score: str, who: str, floor: int) -> DataFrame:
    """The top one of each group; below ``floor`` it is a fallback."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(who))
    top = rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return top.select(*by, who, F.when(F.col(score) >= floor, "voted").otherwise("fallback").alias("via"))


def anchored(rows: DataFrame, by: list[str], tag: str, preferred: str, confidence: str, key: str) -> DataFrame:
    """The anchor of each group: preferred source, commonest tag, confidence, highest id."""
    n = F.count("*").over(Window.partitionBy(*by, tag))
    rows = rows.select(*by, key, confidence, (F.coalesce(F.col(tag) == preferred, F.lit(False))).alias("_own"), n.alias("_n"))
    return rows.groupBy(*by).agg(F.max_by(key, F.struct("_own", "_n", confidence, key)).alias("anchor"))


def next_older(rows: DataFrame, by: list[str], order: str, carried: list[str]) -> DataFrame:
    """Each row with the one before it in ``order``: its key as ``older``, others as older_<name>."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumns({"older": F.lag(order).over(w)} | {f"older_{c}": F.lag(c).over(w) for c in carried})


def closed_vocabulary(name: Column, words: list[str], most: int) -> list[Column]:
    """``canonical`` and ``confidence`` of a name against a closed list: exact 1, within
    ``most`` edits 0.5, otherwise null and 0; the nearest word, then the smallest, wins."""
    near = F.array_min(F.array(*[F.struct(F.levenshtein(name, F.lit(w)).alias("d"), F.lit(w).alias("w")) for w in words]))
    d = near["d"]
    return [F.when(d <= most, near["w"]).alias("canonical"), F.when(d == 0, 1.0).when(d <= most, 0.5).otherwise(0.0).alias("confidence")]


def source_counts(rows: DataFrame, by: list[str], kind: str, key: str, flagged: str) -> DataFrame:
    """n, kinds, first_id, last_id, any_<flagged> and the sorted list of kinds."""
    kinds = F.array_sort(F.collect_set(kind))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct(kind).alias("kinds"), F.min(key).alias("first_id"), F.max(key).alias("last_id"),
        F.bool_or(F.col(kind) == flagged).alias(f"any_{flagged}"), F.array_join(kinds, ",").alias("kind_list"),
    )


def filled(scores: pd.DataFrame, who: str, lane: str) -> list[tuple]:
    """(line, lane, player, reused) by descending score; ties to the smaller player. Players
    already placed are passed over while others are left for the lane."""
    used, out = set(), []
    lanes = {k: list(v.sort_values(["score", who], ascending=[False, True])[who]) for k, v in scores.groupby(lane)}
    for line in range(1, LINES + 1):
        for k in sorted(lanes):
            free = [p for p in lanes[k] if p not in used]
            taken = {p for n, at, p, _ in out if at == k or n == line}
            again = [p for p in lanes[k] if p not in taken]
            if free or again:
                out.append((line, k, int((free or again)[0]), not free))
                used.add(out[-1][2])
    return out


def depth_chart(usage: DataFrame, team: str, who: str, lane: str, games: str) -> DataFrame:
    """Lines of each team. A player's lane score is 100 a game there, 30 more for the lane
    played most and 10 for the second. Filling the lines is sequential, so it is one group
    a team; a team's roster is small whatever the number of games."""
    rank = F.row_number().over(Window.partitionBy(team, who).orderBy(F.desc(games), lane))
    scored = usage.withColumn("score", 100 * F.col(games) + F.when(rank == 1, 30).when(rank == 2, 10).otherwise(0))

    def lines(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(filled(rows, who, lane), columns=["line", lane, who, "reused"])
        out.insert(0, team, rows[team].iloc[0])
        return out

    kinds = dict(usage.dtypes)
    return scored.groupBy(team).applyInPandas(lines, f"{team} {kinds[team]}, line int, {lane} string, {who} {kinds[who]}, reused boolean")
