"""Whole screens promoted to rows: box scores, net charts, faceoff maps and event lists.

Frames (match_id, frame_id, payload) come in the order of frame_id. A later frame fills what earlier
ones could not read and changes nothing else, so a merge is the first value read for each
cell, an aggregate and no loop over frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import fixed
from ..functions.text import plain_tag
from ..sources.scratch import kept
from .bundles import deduplicated_in_order
from .evidence import first_valid, opened_once, whole_number_or_null
from .screens import away_side

#: What the payloads call their parts.
FIELD = "struct<value: variant, raw_text: string, status: string>"
STATS = ["goals", "shots", "faceoffs"]
SHOTS = ["total_shots", "wrist_shots", "slap_shots", "backhand_shots", "snap_shots", "deflections", "power_play_shots"]
ZONES = ["offensive_zone_wins", "offensive_zone_total", "defensive_zone_wins", "defensive_zone_total"]
DOTS = ["lz_top", "lz_bot", "lnz_top", "lnz_bot", "center", "rnz_top", "rnz_bot", "rz_top", "rz_bot"]
#: Misread tags of event kinds, searched in this order.
MISREAD = {
    "goal": r"\bG[\dDO0OQ]AL\b|\bGAOL\b|\bGAUL\b|\bGOA[1IL]\b",
    "shot": r"\bSH[D0OQ]T\b|\bSH[O0]T\b|\b[1IL][O0]HS\b|\bL[O0]HS\b|\b10HS\b",
    "hit": r"\bHIT\b|\bH[1I]T\b",
    "penalty": r"\bPEN(ALTY)?\b",
    "faceoff": r"\bFACE(O[FT]F)?\b|\bFO\b",
}
ALL_PERIODS = -1


def _of(*fields: str) -> str:
    return ", ".join(f"{f}: {FIELD}" for f in fields)


BOX_SCORE = f"stat_kind string, away_team {FIELD}, home_team {FIELD}, periods array<struct<period_label: string, period_number: int, {_of('away_value', 'home_value')}>>"
NET_CHART = f"struct<period_number: int, {_of('period_label', 'away_label', 'home_label', 'away_header_total_shots', 'home_header_total_shots')}, away: struct<{_of(*SHOTS)}>, home: struct<{_of(*SHOTS)}>>"
FACEOFF_MAP = f"period_number int, period_label {FIELD}, away struct<{_of('overall_win_pct', *ZONES)}>, home struct<{_of('overall_win_pct', *ZONES)}>, dots map<string, struct<{_of('away_wins', 'home_wins')}>>"
TRACKER = f"""events array<struct<{_of('raw_text', 'actor_snapshot', 'target_snapshot', 'clock')}, period_label: string, period_number: int, event_type: string>>,
selected_event_x double, selected_event_y double, selected_event_rink_zone string, selected_event_confidence double, selected_event_index int"""


def text_of(f: Column) -> Column:
    """A field's value if it is a text, else what was read; empty texts are none."""
    value = F.when(F.schema_of_variant(f["value"]) == "STRING", F.try_variant_get(f["value"], "$", "string"))
    return F.coalesce(F.nullif(value, F.lit("")), F.nullif(f["raw_text"], F.lit("")))


def number_of(f: Column) -> Column:
    """A field's value as a whole number: halves go up, a text counts by its leading digits."""
    as_text = F.try_variant_get(f["value"], "$", "string")
    as_double = F.try_variant_get(f["value"], "$", "double")
    kind = F.schema_of_variant(f["value"])
    return F.when(kind == "STRING", whole_number_or_null(as_text)).when(~kind.isin("BOOLEAN", "VOID"), F.floor(as_double + 0.5).cast("long"))


def percent_of(f: Column) -> Column:
    """A field's value to two places; a text counts by the number it starts with."""
    kind = F.schema_of_variant(f["value"])
    leading = F.regexp_extract(F.try_variant_get(f["value"], "$", "string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return fixed(F.when(kind == "STRING", leading).when(~kind.isin("BOOLEAN", "VOID"), F.try_variant_get(f["value"], "$", "double")))


def opened(frames: DataFrame, schema: str) -> DataFrame:
    """``frames`` with the payload's parts under ``p``; a payload that is no JSON has none."""
    return opened_once(frames, F.from_json("payload", schema))


def _sided(frames: DataFrame, matches: DataFrame, away: str, home: str, ours: list[str]) -> DataFrame:
    known = matches.select("match_id", "was_home", "opponent")
    away_is = away_side(F.col("was_home"), text_of(F.col("p")[away]), text_of(F.col("p")[home]), F.col("opponent"), ours)
    return frames.join(known, "match_id", "left").withColumn("away_is", away_is)


def _faults(frames: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """``frames`` with ``fault``, the first rule that fails or is not known to hold."""
    return frames.withColumn("fault", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules]))


def box_frames(frames: DataFrame, matches: DataFrame, ours: list[str]) -> DataFrame:
    """Box score frames opened, with away_is and fault (kind, side, cells; null: none). matches:
    match_id, was_home, opponent."""
    rows = _sided(opened(frames, BOX_SCORE), matches, "away_team", "home_team", ours)
    return _faults(rows, ("kind", F.col("p.stat_kind").isin(STATS)), ("side", F.col("away_is").isNotNull()), ("cells", F.size("p.periods") > 0))


def box_score_periods(frames: DataFrame, matches: DataFrame, ours: list[str]) -> DataFrame:
    """match_id, period_number, period_label, frame_id (those of the first frame with the period)
    and goals, shots and faceoffs of both sides (_for, _against), each from the first frame of its
    kind that could read it. Totals (periods below 1) and faulty frames are left out."""
    cells = box_frames(frames, matches, ours).filter("fault IS NULL").select("match_id", "frame_id", "away_is", F.col("p.stat_kind").alias("kind"), F.posexplode("p.periods").alias("pos", "c"))
    away, home, is_for = number_of(F.col("c.away_value")), number_of(F.col("c.home_value")), F.col("away_is") == "for"
    sides = {"for": F.when(is_for, away).otherwise(home), "against": F.when(is_for, home).otherwise(away)}
    columns = {f"{k}_{s}": F.when(F.col("kind") == k, v) for k in STATS for s, v in sides.items()}
    rows = cells.select("match_id", F.col("c.period_number").alias("period_number"), F.struct("c.period_label").alias("label"), "frame_id", "pos", *[v.alias(c) for c, v in columns.items()]).filter("period_number >= 1")
    merged = first_valid(rows, ["match_id", "period_number"], ["frame_id", "pos"], ["label", "frame_id", *columns])
    return merged.select("match_id", "period_number", "label.period_label", "frame_id", *columns)


def net_frames(frames: DataFrame, matches: DataFrame, ours: list[str]) -> DataFrame:
    """Net chart frames opened, with away_is and fault (period, side, blocks; null: none)."""
    rows = _sided(opened(frames, NET_CHART), matches, "away_label", "home_label", ours)
    return _faults(rows, ("period", F.col("p.period_number") != 0), ("side", F.col("away_is").isNotNull()), ("blocks", F.col("p.away").isNotNull() & F.col("p.home").isNotNull()))


def shot_types(frames: DataFrame, matches: DataFrame, ours: list[str]) -> DataFrame:
    """match_id, team_side, period_number, period_label, frame_id and the counts of ``SHOTS``, for
    every period and, as ``ALL_PERIODS``, for the match.

    The row of the match is what the last frame of a period left: sums over the periods, null
    where any is, and the total by that frame's header if it has one. Frames of the whole match
    that came later fill its gaps; those before are overruled. Without frames of periods
    it is the merge of its own frames."""
    good = net_frames(frames, matches, ours).filter("fault IS NULL")
    block = lambda b, away: F.struct(
        F.when(F.lit(away) == (F.col("away_is") == "for"), "for").otherwise("against").alias("team_side"),
        number_of(F.col(f"p.{b}_header_total_shots")).alias("header"), *[number_of(F.col(f"p.{b}.{c}")).alias(c) for c in SHOTS],
    )
    rows = good.select("match_id", "frame_id", F.col("p.period_number").alias("period_number"), text_of(F.col("p.period_label")).alias("period_label"), F.inline(F.array(block("away", True), block("home", False))))
    rows = kept(rows, "net_rows")  # read several times, parsed once
    side = ["match_id", "team_side"]
    place = F.col("frame_id")
    period_rows = rows.filter(F.col("period_number") != ALL_PERIODS)
    periods = period_rows.groupBy(*side, "period_number").agg(F.max_by("period_label", place).alias("period_label"), F.min("frame_id").alias("frame_id"), *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in SHOTS])
    last = period_rows.groupBy(*side).agg(F.max("frame_id").alias("last"), F.max_by("header", place).alias("header"))
    numbered = F.col("period_number") > 0
    strict = lambda c: F.when(F.count_if(numbered & F.col(c).isNull()) == 0, F.sum(F.when(numbered, F.col(c))))
    sums = last.join(periods.groupBy(*side).agg(*[strict(c).alias(c) for c in SHOTS]), side)
    summed = sums.select(*side, F.lit(ALL_PERIODS).alias("period_number"), F.lit("ALL PERIODS").alias("period_label"), F.col("last").alias("frame_id"), F.coalesce("header", SHOTS[0]).alias(SHOTS[0]), *SHOTS[1:])
    direct = rows.filter(F.col("period_number") == ALL_PERIODS).join(last.select(*side, "last"), side, "left").filter("last IS NULL OR frame_id > last")
    whole = summed.unionByName(direct.select(summed.columns)).groupBy(*side, "period_number").agg(
        F.max_by("period_label", place).alias("period_label"), F.min("frame_id").alias("frame_id"), *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in SHOTS]
    )
    return periods.unionByName(whole)


def faceoff_frames(frames: DataFrame) -> DataFrame:
    """Faceoff map frames opened, with fault (period; null: none)."""
    return _faults(opened(frames, FACEOFF_MAP), ("period", F.col("p.period_number") != 0))


def _sure(f: Column) -> Column:
    return F.when(f["status"] == "ok", number_of(f))


def _merged(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Labels of the last frame, frame_id of the first, ``columns`` of the first that read them."""
    return rows.groupBy(*keys).agg(F.max_by("period_label", "frame_id").alias("period_label"), F.min("frame_id").alias("frame_id"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("frame_id"))).alias(c) for c in columns])


def faceoff_zones(frames: DataFrame) -> DataFrame:
    """match_id, period_number, team_side (away, home), period_label, frame_id, overall_win_pct
    and ``ZONES``; a block that a frame lacks gives no row."""
    good = faceoff_frames(frames).filter("fault IS NULL")
    block = lambda b: F.when(F.col(f"p.{b}").isNotNull(), F.struct(F.lit(b).alias("team_side"), percent_of(F.col(f"p.{b}.overall_win_pct")).alias("overall_win_pct"), *[_sure(F.col(f"p.{b}.{c}")).alias(c) for c in ZONES]))
    rows = good.select("match_id", "frame_id", F.col("p.period_number").alias("period_number"), text_of(F.col("p.period_label")).alias("period_label"), F.inline(F.array_compact(F.array(block("away"), block("home")))))
    return _merged(rows, ["match_id", "period_number", "team_side"], ["overall_win_pct", *ZONES])


def faceoff_dots(frames: DataFrame) -> DataFrame:
    """match_id, period_number, dot_id, period_label, frame_id, away_wins and home_wins: all nine
    dots of every period seen, whether or not they were read."""
    good = faceoff_frames(frames).filter("fault IS NULL")
    dot = lambda d, c: _sure(F.try_element_at(F.col("p.dots"), F.lit(d))[c]).alias(c)
    cells = F.array(*[F.struct(F.lit(d).alias("dot_id"), dot(d, "away_wins"), dot(d, "home_wins")) for d in DOTS])
    rows = good.select("match_id", "frame_id", F.col("p.period_number").alias("period_number"), text_of(F.col("p.period_label")).alias("period_label"), F.inline(cells))
    return _merged(rows, ["match_id", "period_number", "dot_id"], ["away_wins", "home_wins"])


def event_kind(parsed: Column, raw: Column) -> Column:
    """The kind that was parsed, or for 'unknown' the first whose misread forms the text holds."""
    t = F.upper(F.coalesce(raw, F.lit("")))
    return F.when(parsed != "unknown", parsed).otherwise(F.coalesce(*[F.when(t.rlike(p), k) for k, p in MISREAD.items()], F.lit("unknown")))


def folder_period(path: Column) -> Column:
    """Period that the folder of a file names: 1st, 2nd, 3rd, or ot (4); else null."""
    folder = F.lower(F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "([^/]*)/[^/]*$", 1))
    return F.when(folder.contains("1st"), 1).when(folder.contains("2nd"), 2).when(folder.contains("3rd"), 3).when(folder.contains("ot"), 4)


def tracked(frames: DataFrame, players: DataFrame) -> DataFrame:
    """One row an event of the list screens' frames (match_id, frame_id, path, payload): period_number,
    period_label, clock, event_type, actor, actor_id, target, target_id, raw, whether it is the
    marked one (with x, y, rink_zone and confidence then), and fault: type, clock, actor or period,
    the first that is missing. ids come from players (tag, player_id), the smallest of a tag."""
    rows = opened(frames, TRACKER).select("match_id", "frame_id", "path", "p", F.posexplode("p.events").alias("pos", "e"))
    raw = text_of(F.col("e.raw_text"))
    marked = F.coalesce(F.col("pos") == F.col("p.selected_event_index"), F.lit(False))
    number = F.when(F.col("e.period_number") >= 1, F.col("e.period_number")).otherwise(F.coalesce(folder_period(F.col("path")), F.col("e.period_number")))
    events = rows.select(
        "match_id", "frame_id", "pos", number.alias("period_number"), F.coalesce(F.nullif("e.period_label", F.lit("")), number.cast("string")).alias("period_label"), text_of(F.col("e.clock")).alias("clock"), event_kind(F.col("e.event_type"), raw).alias("event_type"),
        text_of(F.col("e.actor_snapshot")).alias("actor"), text_of(F.col("e.target_snapshot")).alias("target"), raw.alias("raw"),
        *[F.when(marked & F.col("p.selected_event_x").isNotNull() & F.col("p.selected_event_y").isNotNull(), F.col(f"p.selected_event_{c}")).alias(c) for c in ("x", "y", "rink_zone", "confidence")], marked.alias("marked"),
    )
    ids = players.select(plain_tag(F.col("tag")).alias("_tag"), "player_id").filter("_tag <> ''").groupBy("_tag")
    for who in ("actor", "target"):
        events = events.withColumn("_tag", plain_tag(F.col(who))).join(ids.agg(F.min("player_id").alias(f"{who}_id")), "_tag", "left").drop("_tag")
    return _faults(events, ("type", F.col("event_type") != "unknown"), ("clock", F.col("clock").isNotNull()), ("actor", F.col("actor").isNotNull()), ("period", F.col("period_number") >= 1))


def tracker_events(events: DataFrame, stored: DataFrame) -> DataFrame:
    """What ``tracked`` events make of the stored ones (id > 0, match_id, period_number, event_type, clock,
    actor_id, actor, x, y), taken in order of frames and places: one row for each event that is
    inserted (a negative id) or updated, with outcome insert or update.

    An insert holds the values of its first reading, ours ('for') if the actor is known, else
    'against', side_known where either end is. On both, the latest target read, the latest frame
    and the latest mark (x and y to two places, interpolated from a confidence of 0.5) win. Of
    several stored candidates the smallest id counts, and stored ones before those of the run."""
    good = events.filter("fault IS NULL")
    place = F.shiftleft(F.col("frame_id").cast("long"), 16) + F.when(F.col("pos") < 65536, F.col("pos")).otherwise(F.raise_error(F.lit("over 65536 events in a frame")).cast("long"))
    good = kept(good.withColumn("place", place).withColumn("id", -1 - F.col("place")), "tracked")
    bucket = ["match_id", "period_number", "event_type", "clock"]
    unplaced = lambda df: df.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    found = deduplicated_in_order(unplaced(stored), unplaced(good), bucket, "place")
    first = F.array_min(F.transform("candidates", lambda i: F.struct((i < 0).alias("new"), F.abs(i).alias("n"), i.alias("i"))))["i"]
    rows = good.join(found.select("id", F.coalesce(first, F.col("id")).alias("event_id")), "id")
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("place"))
    first_read = ["match_id", "period_number", "period_label", "clock", "event_type", "actor_id", "actor", "raw"]
    one = rows.groupBy("event_id").agg(
        *[F.min_by(c, "place").alias(c) for c in first_read], F.min_by(F.col("actor_id").isNotNull() | F.col("target_id").isNotNull(), "place").alias("side_known"), *[F.max_by(c, at(c)).alias(c) for c in ("target_id", "target")], F.max("frame_id").alias("frame_id"),
        F.max_by(F.struct("x", "y", "rink_zone", "confidence"), at("x")).alias("m"), F.count("*").alias("readings"),
    )
    new = F.col("event_id") < 0
    position = F.when(F.col("m.confidence") >= 0.5, "interpolated").when(F.col("m.confidence").isNotNull(), "extrapolated")
    own = lambda c: F.when(new, c)
    return one.select(
        F.col("event_id").alias("id"), F.when(new, "insert").otherwise("update").alias("outcome"), *first_read[:5], *[own(F.col(c)).alias(c) for c in ("actor_id", "actor", "raw")],
        own(F.when(F.col("actor_id").isNotNull(), "for").otherwise("against")).alias("team_side"), own(F.col("side_known")).alias("side_known"), "target_id", "target", "frame_id", fixed(F.col("m.x")).alias("x"), fixed(F.col("m.y")).alias("y"),
        F.col("m.rink_zone").alias("rink_zone"), position.alias("position"), "readings",
    )
