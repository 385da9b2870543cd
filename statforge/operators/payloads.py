"""Match and member payloads (JSON text) to typed rows, and JSON fields to rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clock import from_epoch
from .evidence import opened_once, whole_number, whole_number_or_null

CLUB = "struct<score:string,goals:string,result:string,winnerByDnf:string,winnerByGoalieDnf:string,name:string,details:struct<name:string>,toa:string,timeOnAttack:string,cNhlOnlineGameType:string,passa:string,passc:string,ppg:string,ppo:string,teamSide:string>"
PAYLOAD = f"matchId string, timestamp string, clubs map<string,{CLUB}>, aggregate map<string,map<string,string>>, players map<string,map<string,map<string,string>>>"
#: Codes of game types and of results.
MODES = {"5": "6s", "10": "6s", "200": "3s"}
WON, LOST, OVERTIME_LOSS = (1, 5, 16385), (2,), 6
#: Columns of a player row and the payload fields that they are counted from.
COUNTERS = {
    "goals": "skgoals", "assists": "skassists", "plus_minus": "skplusmin", "shots": "skshots", "hits": "skhits", "pim": "skpim", "takeaways": "sktakeaways",
    "giveaways": "skgiveaways", "faceoff_wins": "skfow", "faceoff_losses": "skfol", "pass_attempts": "skpassattempts", "shot_attempts": "skshotattempts",
    "blocked_shots": "skbs", "pp_goals": "skppg", "sh_goals": "skshg", "interceptions": "skinterceptions", "possession": "skpossession",
}
#: Columns of both sides of a match that stand in the club's own fields.
CLUB_NUMBERS = {"pass_attempts": "passa", "pass_completions": "passc", "pp_goals": "ppg", "pp_opportunities": "ppo"}
GOALIE_COUNTERS = {"saves": "glsaves", "goals_against": "glga", "shots_against": "glshots", "breakaway_saves": "glbrksaves", "desperation_saves": "gldsaves", "poke_checks": "glpokechecks"}


def parsed_matches(payloads: DataFrame, club: Column) -> DataFrame:
    """``payloads`` (payload) with ``p`` (the parsed payload), ``ours`` and ``theirs`` (club
    ids) and ``problem``: null, or why no match can be read from it. Bad payloads keep
    their rows, so a caller can set them aside."""
    rows = opened_once(payloads, F.from_json("payload", PAYLOAD)).withColumn("ours", club)
    rows = rows.withColumn("theirs", F.get(F.filter(F.map_keys("p.clubs"), lambda k: k != F.col("ours")), F.lit(0)))
    has_ours = F.coalesce(F.array_contains(F.map_keys("p.clubs"), F.col("ours")), F.lit(False))
    problem = F.when(F.coalesce(F.col("p.matchId"), F.lit("")) == "", "no matchId").when(whole_number_or_null(F.col("p.timestamp")).isNull(), "no timestamp")
    problem = problem.when(~has_ours, "our club is not in the match").when(F.col("theirs").isNull(), "no opponent club")
    return rows.withColumn("problem", problem)


def score_of(club: Column) -> Column:
    return F.coalesce(whole_number_or_null(club["score"]), whole_number_or_null(club["goals"]), F.lit(0).cast("long"))


def result_of(ours: Column, theirs: Column) -> Column:
    """An overtime loss by its code; else won or lost by code, or by score; a loss that the
    opponent took by a walkover is DNF."""
    code = whole_number_or_null(ours["result"])
    base = F.when(code.isin(*WON), "WIN").when(code.isin(*LOST), "LOSS").when(score_of(ours) > score_of(theirs), "WIN").otherwise("LOSS")
    walkover = F.coalesce(whole_number_or_null(theirs["winnerByDnf"]) == 1, F.lit(False)) | F.coalesce(whole_number_or_null(theirs["winnerByGoalieDnf"]) == 1, F.lit(False))
    return F.when(code == OVERTIME_LOSS, "OTL").when((base == "LOSS") & walkover, "DNF").otherwise(base)


def first_number(values: Column, *keys: str) -> Column:
    return F.coalesce(*[whole_number_or_null(values[k]) for k in keys], F.lit(0).cast("long"))


def positive(number: Column) -> Column:
    """Null where a total was never recorded, which payloads write as 0."""
    return F.when(number > 0, number)


def match_rows(parsed: DataFrame) -> DataFrame:
    """One row for each readable match of ``parsed_matches``."""
    a, b = (F.element_at("p.clubs", F.col(c)) for c in ("ours", "theirs"))
    x, y = (F.element_at("p.aggregate", F.col(c)) for c in ("ours", "theirs"))
    total = lambda side, field: F.aggregate(F.map_values(F.element_at("p.players", F.col(side))), F.lit(0).cast("long"), lambda s, r: s + first_number(r, field))
    parsed = parsed.withColumns({"_wins": F.greatest(total("ours", "skfow"), total("theirs", "skfol")), "_losses": F.greatest(total("ours", "skfol"), total("theirs", "skfow"))})
    wins, losses = F.col("_wins"), F.col("_losses")
    pct = F.when(wins + losses > 0, F.round(wins.cast("decimal(20,0)") * 100 / (wins + losses).cast("decimal(20,0)"), 2).cast("double"))
    side = F.coalesce(whole_number_or_null(a["teamSide"]), whole_number_or_null(F.get(F.filter(F.transform(F.map_values(F.element_at("p.players", F.col("ours"))), lambda r: r["teamSide"]), lambda s: s.isNotNull()), F.lit(0))))
    code = whole_number_or_null(a["cNhlOnlineGameType"])
    mode = F.element_at(F.create_map(*[F.lit(v) for kv in MODES.items() for v in kv]), code.cast("string"))
    return parsed.filter("problem IS NULL").select(
        F.col("p.matchId").alias("match_id"), F.col("theirs").alias("opponent_club_id"), F.coalesce(b["details"]["name"], b["name"], F.col("theirs")).alias("opponent_name"),
        from_epoch(whole_number_or_null(F.col("p.timestamp"))).alias("played_at"), result_of(a, b).alias("result"), score_of(a).alias("score_for"), score_of(b).alias("score_against"),
        F.when(side == 0, True).when(side == 1, False).alias("was_home"), first_number(x, "shots", "skshots").alias("shots_for"), first_number(y, "shots", "skshots").alias("shots_against"),
        first_number(x, "hits", "skhits").alias("hits_for"), first_number(y, "hits", "skhits").alias("hits_against"), pct.alias("faceoff_pct"),
        positive(first_number(a, "toa", "timeOnAttack")).alias("time_on_attack"), positive(first_number(b, "toa", "timeOnAttack")).alias("time_on_attack_against"),
        positive(first_number(x, "pim", "skpim")).alias("penalty_minutes"), positive(first_number(y, "pim", "skpim")).alias("penalty_minutes_against"),
        code.alias("game_type"), mode.alias("game_mode"), *[whole_number_or_null(club[f]).alias(f"{c}{end}") for club, end in ((a, ""), (b, "_against")) for c, f in CLUB_NUMBERS.items()],
    )


def player_rows(parsed: DataFrame) -> DataFrame:
    """One row for each player of either side of a readable match. Counters are 0 where
    missing and fail where they are no numbers; goalie counters are null for skaters."""
    sides = parsed.filter("problem IS NULL").select(F.col("p.matchId").alias("match_id"), "p", F.explode(F.array(F.struct(F.col("ours").alias("club"), F.lit("for").alias("side")), F.struct(F.col("theirs").alias("club"), F.lit("against").alias("side")))).alias("s"))
    rows = sides.select("match_id", "s.*", F.explode(F.element_at("p.players", F.col("s.club"))).alias("player_key", "r"))
    goalie = F.coalesce(F.col("r")["position"] == "goalie", F.lit(False))
    field = lambda name: whole_number(F.col("r")[name])
    completed = F.floor(field("skpassattempts") * (F.coalesce(F.col("r")["skpasspct"].try_cast("double"), F.lit(0.0)) / 100) + 0.5).cast("long")
    return rows.select(
        "match_id", "side", "club", "player_key", F.col("r")["playername"].alias("gamertag"), F.col("r")["position"].alias("position"), goalie.alias("is_goalie"),
        *[field(f).alias(c) for c, f in COUNTERS.items()], F.when(field("skpassattempts") > 0, completed).otherwise(0).alias("pass_completions"),
        whole_number_or_null(F.col("r")["toiseconds"]).alias("toi_seconds"), (field("player_dnf") == 1).alias("dnf"), *[F.when(goalie, field(f)).alias(c) for c, f in GOALIE_COUNTERS.items()],
    )


MEMBER = "map<string,string>"
ZONES = {"ice": ("skShotsLocationOnIce", 16), "net": ("skShotsLocationOnNet", 5)}


def member_rows(payloads: DataFrame) -> DataFrame:
    """A season row from each member payload: counters 0 where missing, goalie fields null
    without goalie games, minutes as seconds, and shot zones as arrays, null unless all are
    there and the two sum to the same number of shots."""
    m = payloads.withColumn("m", F.from_json("payload", MEMBER))
    field = lambda name: whole_number(F.col("m")[name])
    goalie = field("glgp") > 0
    zones = {z: F.array(*[whole_number_or_null(F.col("m")[f"{name}{i}"]) for i in range(1, n + 1)]) for z, (name, n) in ZONES.items()}
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    fine = F.coalesce(total(zones["ice"]) == total(zones["net"]), F.lit(False))
    return m.select(
        F.col("m")["name"].alias("gamertag"), F.col("m")["favoritePosition"].alias("favorite_position"), field("gamesplayed").alias("games_played"), field("skgp").alias("skater_gp"), field("glgp").alias("goalie_gp"),
        field("skgoals").alias("goals"), field("skassists").alias("assists"), (field("sktoi") * 60).alias("toi_seconds"), F.when(goalie, field("glsaves")).alias("saves"),
        F.when(goalie, F.round(F.col("m")["glsavepct"].try_cast("decimal(10,4)"), 2)).cast("double").alias("save_pct"), F.when(fine, zones["ice"]).alias("shots_ice"), F.when(fine, zones["net"]).alias("shots_net"),
    )


#: Screen -> the array of the payload that holds its rows, and the fields of a row.
SCREENS = {"box_score": ("rows", ["gamertag", "goals", "assists"]), "lobby": ("slots", ["gamertag", "position", "level"]), "events": ("events", ["clock", "actor", "type"])}


def field_rows(payloads: DataFrame, screen: str) -> DataFrame:
    """extraction_id, slot, field_key, value and confidence for each field that a payload of
    a screen holds; null fields give no row."""
    name, fields = SCREENS[screen]
    kind = T.StructType([T.StructField(name, T.ArrayType(T.StructType([T.StructField(f, T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())])) for f in fields])))])
    rows = payloads.filter(F.col("screen") == screen).select("extraction_id", F.posexplode(F.from_json("payload", kind)[name]).alias("slot", "r"))
    cells = F.array(*[F.struct(F.lit(f).alias("field_key"), F.col("r")[f]["value"].alias("value"), F.col("r")[f]["confidence"].alias("confidence")) for f in fields])
    return rows.select("extraction_id", "slot", F.inline(cells)).filter("value IS NOT NULL")


def keep_field(stored: Column, incoming: Column, field: str, fields: list[str]) -> Column:
    """The incoming JSON object with ``field`` as it stands in the stored one, if it is there."""
    old, new = F.from_json(stored, "map<string,string>"), F.from_json(incoming, "map<string,string>")
    value = lambda f: F.coalesce(old[f], new[f]) if f == field else new[f]
    return F.to_json(F.struct(*[value(f).alias(f) for f in fields]))
