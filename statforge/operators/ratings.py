"""Ratings of players and sides: weighted sums with their parts, possession, completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Counters that show a player took part, and weights of a score's parts.
ACTIVITY = {
    "skater": ["goals", "assists", "plus_minus", "shots", "hits", "interceptions", "blocked_shots", "takeaways", "giveaways", "faceoff_wins", "faceoff_losses", "penalties_drawn", "pim"],
    "goalie": ["saves", "goals_against", "shots_against", "desperation_saves", "breakaway_saves", "penalty_saves", "poke_checks"],
}
WEIGHTS = {
    "skater": {
        "goals": 4.0, "assists": 3.25, "takeaways": 0.55, "interceptions": 0.45, "blocked_shots": 0.45, "penalties_drawn": 0.4,
        "giveaways": -0.45, "pim": -0.3, "shots": 0.12, "plus_minus": 0.2, "hits": 0.08, "faceoff_net": 0.08,
    },
    "goalie": {"saves": 0.2, "save_share": 15.0, "goals_against": -0.8, "desperation_saves": 0.5, "breakaway_saves": 0.8, "penalty_saves": 0.8, "poke_checks": 0.15},
}
WIN_BONUS = 1.0
#: Weights of the shares of possession, by which of attack time and faceoffs are known.
POSSESSION = {
    (True, True): {"shots": 0.4, "attack": 0.3, "faceoffs": 0.2, "hits": 0.1},
    (True, False): {"shots": 0.5, "attack": 0.35, "hits": 0.15},
    (False, True): {"shots": 0.55, "faceoffs": 0.3, "hits": 0.15},
    (False, False): {"shots": 0.7, "hits": 0.3},
}


def number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def took_part(goalie: Column) -> Column:
    """Whether any counter of a player's role was counted: above 0, plus_minus not 0."""
    seen = lambda c: number(c) != 0 if c == "plus_minus" else number(c) > 0
    some = {role: reduce(lambda a, b: a | b, map(seen, names)) for role, names in ACTIVITY.items()}
    return F.when(goalie, some["goalie"]).otherwise(some["skater"])


def winner(result: Column, ours: Column, theirs: Column) -> Column:
    """for or against by the score; null for a tie and for a match that was not finished."""
    return F.when(result == "DNF", None).when(ours > theirs, "for").when(theirs > ours, "against")


def score_parts(goalie: Column, won: Column) -> Column:
    """Array of (part, value, weight, points) in the order of ``WEIGHTS``; the win bonus is last, for winners only."""
    derived = {
        "faceoff_net": number("faceoff_wins") - number("faceoff_losses"),
        "save_share": F.when(number("shots_against") > 0, number("saves") / number("shots_against")).otherwise(0.0),
    }
    part = lambda name, value, weight: F.struct(F.lit(name).alias("part"), value.alias("value"), F.lit(weight).alias("weight"), (value * weight).alias("points"))
    parts = {role: F.array(*[part(n, derived[n] if n in derived else number(n), w) for n, w in weights.items()]) for role, weights in WEIGHTS.items()}
    bonus = F.array(part("win_bonus", F.lit(1.0), WIN_BONUS))
    return F.concat(F.when(goalie, parts["goalie"]).otherwise(parts["skater"]), F.when(F.coalesce(won, F.lit(False)), bonus).otherwise(F.filter(bonus, lambda _: F.lit(False))))


def rated(players: DataFrame) -> DataFrame:
    """``players`` (is_goalie, side, winner and the counters) with parts, score, took_part and
    faceoff_pct (null without faceoffs). Null counters count as 0."""
    goalie = F.coalesce("is_goalie", F.lit(False))
    rows = players.withColumn("parts", score_parts(goalie, F.col("winner") == F.col("side")))
    taken = number("faceoff_wins") + number("faceoff_losses")
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["points"])
    return rows.withColumns({"score": score, "took_part": took_part(goalie), "faceoff_pct": F.when(taken > 0, number("faceoff_wins") / taken * 100)})


def possession(matches: DataFrame) -> DataFrame:
    """``matches`` with known (which of attack and faceoffs are known), edge (0 to 100, one
    decimal) and edge_for and edge_against (whole, adding up to 100), null where there are neither
    shots nor hits. Shots read from screens (read_shots_for, read_shots_against) outrank the payload's,
    each for itself; a share without a total is one half. Needs shots, hits and attack of both sides and faceoff_pct."""
    pair = lambda name: [F.col(f"{name}_{side}").cast("double") for side in ("for", "against")]
    shots = [F.coalesce(read.cast("double"), c) for read, c in zip((F.col("read_shots_for"), F.col("read_shots_against")), pair("shots"), strict=True)]
    hits, attack = pair("hits"), pair("attack")
    half = lambda p: F.when(p[0] + p[1] > 0, p[0] / (p[0] + p[1])).otherwise(0.5)
    shares = {"shots": half(shots), "hits": half(hits), "attack": F.when(attack[0] + attack[1] > 0, attack[0] / (attack[0] + attack[1])), "faceoffs": F.col("faceoff_pct").cast("double") / 100}
    known = [shares["attack"].isNotNull(), shares["faceoffs"].isNotNull()]
    mix = F.lit(None).cast("double")
    for (a, f), weights in POSSESSION.items():
        total = reduce(lambda x, y: x + y, [shares[n] * w for n, w in weights.items()])
        mix = F.when((known[0] == a) & (known[1] == f), total).otherwise(mix)
    nothing = (shots[0] + shots[1] == 0) & (hits[0] + hits[1] == 0)
    raw = F.when(~nothing, F.greatest(F.lit(0.0), F.least(F.lit(100.0), mix * 100)))
    whole = F.floor(raw + 0.5)
    label = F.concat_ws("+", F.when(known[0], "attack"), F.when(known[1], "faceoffs"))
    return matches.withColumns({"known": label, "edge": F.floor(raw * 10 + 0.5) / 10, "edge_for": whole, "edge_against": 100 - whole})


def completeness(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, six buckets and ``overall``, the mean of those that have a denominator.

    rows: identity (array of fields), build (text of either kind), bio (array of fields),
    attributes (their number) and traits (array of (name, tier)). A trait's name and tier are
    shared among all traits of the group and null without any."""
    there = lambda a: F.size(F.filter(a, lambda x: x.isNotNull())) / F.size(a)
    count = lambda test: F.sum(F.size(F.filter(F.coalesce("traits", F.array().cast(rows.schema["traits"].dataType)), test)))
    total = count(lambda t: F.lit(True))
    buckets = {
        "identity": F.avg(there("identity")), "build": F.avg(F.col("build").isNotNull().cast("int")), "bio": F.avg(there("bio")), "attribute": F.avg((F.coalesce("attributes", F.lit(0)) > 0).cast("int")),
        "trait": F.when(total > 0, count(lambda t: t["name"].isNotNull()) / total), "tier": F.when(total > 0, count(lambda t: t["tier"].isNotNull()) / total),
    }
    g = rows.groupBy(*by).agg(*[c.alias(n) for n, c in buckets.items()])
    known = F.filter(F.array(*buckets), lambda b: b.isNotNull())
    return g.withColumn("overall", F.aggregate(known, F.lit(0.0), lambda s, b: s + b) / F.size(known))


def zone_totals(rows: DataFrame, by: list[str], arrays: dict[str, int]) -> DataFrame:
    """by, n and for each array (name: length) sums and means by position: <name>_sum and
    <name>_mean. Missing elements are 0 and so are the means of no rows; one pass, summed before the shuffle."""
    cell = lambda name, i: F.coalesce(F.sum(F.coalesce(F.try_element_at(name, F.lit(i + 1)), F.lit(0)).cast("long")), F.lit(0).cast("long"))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.array(*[cell(name, i) for i in range(width)]).alias(f"{name}_sum") for name, width in arrays.items()])
    mean = lambda name: F.transform(f"{name}_sum", lambda x: F.when(F.col("n") > 0, x.cast("double") / F.col("n")).otherwise(0.0))
    return g.withColumns({f"{name}_mean": mean(name) for name in arrays})
