"""Promotion of whole screens: merges by hand, the match's net row against a loop over frames, event
lists against one reading at a time."""

import json
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from statforge.plans import registry
from statforge.functions.formats import fixed
from statforge.operators.promoters import SHOTS, box_frames, box_score_periods, event_kind, faceoff_dots, faceoff_zones, folder_period, net_frames, shot_types, tracked, tracker_events

FRAMES = "match_id long, frame_id long, payload string"
STORED = "id long, match_id long, period_number int, event_type string, clock string, actor_id long, actor string"


def field(value, raw=None, status="ok"):
    return {"value": value, "raw_text": raw, "status": status}


def matches(spark, *rows):
    return spark.createDataFrame(list(rows) or [(1, False, "X")], "match_id long, was_home boolean, opponent string")


def frames(spark, *payloads):
    return spark.createDataFrame([(1, i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads, 1)], FRAMES)


def test_fixed(spark):
    values = [1.005, 2.675, 0.125, -0.125, 0.005, 0.004999, 1e-9, 0.0, 12345.675, -3.335] + [random.Random(5).uniform(-500, 500) for _ in range(500)] + [k / 200 for k in range(1000)]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", fixed(F.col("x")).alias("f")).collect():
        assert r.f == Decimal(r.x).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert spark.range(1).select(fixed(F.lit(None).cast("double"))).first()[0] is None


def box(kind, *cells, away="A", home="B"):
    return {"stat_kind": kind, "away_team": field(away), "home_team": field(None, home), "periods": [{"period_label": label, "period_number": n, "away_value": field(a), "home_value": field(h)} for label, n, a, h in cells]}


def test_box_score_fills_gaps_only(spark):
    rows = frames(spark, box("goals", ("1ST", 1, 2.5, "4x"), ("2ND", 2, None, 1), ("TOT", -1, 9, 9)), box("goals", ("new", 1, 7, 7), (None, 2, "6", 8)), box("shots", (None, 1, True, None), ("OT", 4, 3, 0)), "no JSON", None)
    got = {r.period_number: r for r in box_score_periods(rows, matches(spark), []).collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].period_label, got[1].frame_id, got[1].goals_for, got[1].goals_against, got[1].shots_for) == ("1ST", 1, 3, 4, None)
    assert (got[2].goals_for, got[2].goals_against) == (6, 1)
    assert (got[4].period_label, got[4].frame_id, got[4].goals_for, got[4].shots_for, got[4].shots_against) == ("OT", 3, None, 3, 0)
    at_home = {r.period_number: r for r in box_score_periods(rows, matches(spark, (1, True, "X")), []).collect()}
    assert (at_home[1].goals_for, at_home[1].goals_against) == (4, 3)


def test_box_faults(spark):
    rows = frames(spark, box("goals", (None, 1, 1, 1)), box("saves", (None, 1, 1, 1)), box("goals"), "x", None, box("shots", (None, 1, 1, 1), away="Us"))
    fault = lambda was_home: [r.fault for r in box_frames(rows, matches(spark, (1, was_home, "X")), ["us"]).orderBy("frame_id").collect()]
    assert fault(True) == [None, "kind", "cells", "kind", "kind", None]
    assert fault(None) == ["side", "kind", "side", "kind", "kind", None]
    assert box_frames(rows, matches(spark, (2, True, "X")), []).filter("fault IS NULL").isEmpty()
    assert box_score_periods(rows.limit(0), matches(spark), []).isEmpty()


def net_loop(seq):
    """The table after frames one by one: (period, away, home, header_away, header_home), away is ours."""
    table = {}
    for place, (period, label, blocks, headers) in enumerate(seq, 1):
        for side in ("for", "against"):
            slot = table.get((side, period))
            values = blocks[side]
            if slot is None:
                table[side, period] = [label, place, *values]
            else:
                slot[0] = label
                slot[2:] = [a if a is not None else b for a, b in zip(slot[2:], values, strict=True)]
            if period != -1:
                parts = [v[2:] for (s, p), v in table.items() if s == side and p > 0]
                sums = [None if not c or None in c else sum(c) for c in zip(*parts, strict=True)] or [None] * len(SHOTS)
                if headers[side] is not None:
                    sums[0] = headers[side]
                table[side, -1] = ["ALL PERIODS", place, *sums]
    return {(s, p, *v) for (s, p), v in table.items()}


@pytest.mark.parametrize("seed", range(6))
def test_net_chart_equals_loop(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, rng.randrange(30)])
    runs, rows = {}, []
    for match in range(12):
        choices = rng.choice([[-1], [1, 2], [-1, 1, 2, 3], [-2, -1, 1]])
        runs[match] = [(rng.choice(choices), rng.choice([None, "L"]), {s: [some() for _ in SHOTS] for s in ("for", "against")}, {s: some() for s in ("for", "against")}) for _ in range(rng.randrange(1, 7))]
        for place, (period, label, blocks, headers) in enumerate(runs[match], 1):
            part = lambda s: {c: field(v) for c, v in zip(SHOTS, blocks[s], strict=True)}  # noqa: E731, B023
            payload = {"period_number": period, "period_label": field(label), "away": part("for"), "home": part("against"), "away_header_total_shots": field(headers["for"]), "home_header_total_shots": field(headers["against"])}
            rows.append((match, place, json.dumps(payload)))
    got = {}
    for r in shot_types(spark.createDataFrame(rows, FRAMES), matches(spark, *[(m, False, "X") for m in runs]), []).collect():
        got.setdefault(r.match_id, set()).add((r.team_side, r.period_number, r.period_label, r.frame_id, *[r[c] for c in SHOTS]))
    assert got == {m: net_loop(seq) for m, seq in runs.items()}


def test_net_faults(spark):
    block = {c: field(1) for c in SHOTS}
    rows = frames(spark, {"period_number": 0, "away": block, "home": block}, {"away": block, "home": block}, {"period_number": 1, "away": block}, {"period_number": 1, "away": block, "home": block}, "x")
    assert [r.fault for r in net_frames(rows, matches(spark), []).orderBy("frame_id").collect()] == ["period", "period", "blocks", None, "period"]


def test_faceoff_maps(spark):
    side = lambda pct, wins, status="ok": {"overall_win_pct": field(pct, None, "uncertain"), "offensive_zone_wins": field(wins, None, status)}
    rows = frames(
        spark, {"period_number": 1, "period_label": field("noisy"), "away": side(1.005, 3, "uncertain"), "dots": {"center": {"away_wins": field(2), "home_wins": field(1, None, "missing")}}},
        {"period_number": 1, "period_label": field("1ST"), "away": side(60, "5"), "home": side("41.5%", 1), "dots": {"center": {"away_wins": field(9), "home_wins": field(4)}, "other": {"away_wins": field(1)}}}, {"period_number": 0, "away": side(1, 1)},
    )
    zones = {r.team_side: r for r in faceoff_zones(rows).collect()}
    assert (zones["away"].period_label, zones["away"].frame_id, zones["away"].overall_win_pct, zones["away"].offensive_zone_wins) == ("1ST", 1, Decimal("1.00"), 5)
    assert (zones["home"].frame_id, zones["home"].overall_win_pct, zones["home"].defensive_zone_wins) == (2, Decimal("41.50"), None)
    dots = {r.dot_id: r for r in faceoff_dots(rows).collect()}
    assert len(dots) == 9 and (dots["center"].away_wins, dots["center"].home_wins, dots["lz_top"].away_wins) == (2, 4, None)


@pytest.mark.parametrize(("parsed", "raw", "want"), [("unknown", "x GDAL", "goal"), ("unknown", "sh0t", "shot"), ("unknown", "10HS", "shot"), ("unknown", "GOAL SHOT", "goal"), ("unknown", "GQAI SHOT", "shot"), ("unknown", "H1T", "hit"), ("unknown", "PENALTY", "penalty"), ("unknown", "PENAL", "unknown"), ("unknown", "FACEOFF", "faceoff"), ("unknown", None, "unknown"), ("hit", "SHOT", "hit")])
def test_event_kind(spark, parsed, raw, want):
    assert spark.createDataFrame([(parsed, raw)], "p string, r string").select(event_kind(F.col("p"), F.col("r"))).first()[0] == want


@pytest.mark.parametrize(("path", "want"), [("a/1st/x.png", 1), ("a\\2nd Period\\x.png", 2), ("/3RD/x/", 3), ("z/Goals OT/x", 4), ("x.png", None), ("1st", None), (None, None)])
def test_folder_period(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(folder_period(F.col("p"))).first()[0] == want


def listed(clock, actor, target=None, kind="shot", period=1):
    return {"raw_text": field("t"), "period_label": "", "period_number": period, "event_type": kind, "clock": field(clock), "actor_snapshot": field(actor), "target_snapshot": field(target)}


def screens(spark, *payloads):
    return spark.createDataFrame([(1, i, "in/d.png", json.dumps({"events": e, **m})) for i, (e, m) in enumerate(payloads, 1)], "match_id long, frame_id long, path string, payload string")


def test_tracker(spark):
    mark = {"selected_event_x": 1.005, "selected_event_y": -2, "selected_event_rink_zone": "neutral", "selected_event_confidence": 0.3, "selected_event_index": 1}
    players = spark.createDataFrame([("Wil-de", 7), ("wilde", 5), ("Orr", 9)], "tag string, player_id long")
    shown = screens(
        spark, ([listed("1:00", "Wilde", "Foe"), listed("2:00", "Stranger")], mark), ([listed("2:00", "Strangr", "Orr"), listed("1:00", "WILDE", None)], {"selected_event_index": 9}),
        ([listed("3:00", "Kept One", "Foe"), listed(None, "a"), listed("1:00", None), listed("1:00", "a", kind="unknown"), listed("1:00", "a", period=0)], mark | {"selected_event_confidence": 0.5, "selected_event_index": 0}),
    )
    stored = spark.createDataFrame([(4, 1, 1, "shot", "3:00", None, "Kept Ono"), (3, 1, 1, "hit", "3:00", None, "Kept One")], STORED)
    rows = tracked(shown, players)
    assert sorted(r.fault for r in rows.filter("fault IS NOT NULL").collect()) == ["actor", "clock", "period", "type"]
    got = {r.clock: r for r in tracker_events(rows, stored).collect()}
    assert len(got) == 3
    a, b, c = got["1:00"], got["2:00"], got["3:00"]
    assert (a.outcome, a.actor_id, a.team_side, a.side_known, a.target, a.frame_id, a.x, a.readings) == ("insert", 5, "for", True, "Foe", 2, None, 2)
    assert (b.outcome, b.actor, b.team_side, b.side_known, b.target_id, b.x, b.y, b.position) == ("insert", "Stranger", "against", False, 9, Decimal("1.00"), Decimal("-2.00"), "extrapolated")
    assert (c.id, c.outcome, c.actor, c.team_side, c.target, c.position, c.rink_zone) == (4, "update", None, None, "Foe", "interpolated", "neutral")
    assert tracker_events(rows.limit(0), stored).isEmpty()


def test_tracker_equals_one_at_a_time(spark):
    """Names are equal or far apart, so whom a reading meets is plain: the same name in its bucket."""
    rng = random.Random(3)
    names = ["Aldermoor", "Bexley", "Cottingham", "Dunwich"]
    shown = [([listed(f"{rng.randrange(3)}:00", rng.choice(names), rng.choice([None, *names])) for _ in range(rng.randrange(6))], {"selected_event_index": rng.randrange(6), "selected_event_x": rng.choice([None, rng.randrange(9) / 8]), "selected_event_y": 1.0}) for _ in range(30)]
    stored = [(1, 1, 1, "shot", "0:00", None, "Bexley"), (2, 1, 1, "shot", "1:00", None, "Dunwich")]
    table = {(s[4], s[6]): [s[0], None, None, None, 0] for s in stored}
    for frame, (events, m) in enumerate(shown, 1):
        for pos, e in enumerate(events):
            clock, actor, target = (e[k]["value"] for k in ("clock", "actor_snapshot", "target_snapshot"))
            slot = table.setdefault((clock, actor), [-1 - (frame << 16) - pos, None, None, None, 0])
            slot[1], slot[3], slot[4] = target or slot[1], frame, slot[4] + 1
            if pos == m["selected_event_index"] and m["selected_event_x"] is not None:
                slot[2] = Decimal(m["selected_event_x"]).quantize(Decimal("0.01"), ROUND_HALF_UP)
    rows = tracked(screens(spark, *shown), spark.createDataFrame([], "tag string, player_id long"))
    got = {(r.id, r.target, r.x, r.frame_id, r.readings) for r in tracker_events(rows, spark.createDataFrame(stored, STORED)).collect()}
    assert got == {tuple(v) for v in table.values() if v[4]}


@pytest.mark.parametrize("name", ["payload_matches", "payload_players", "shot_type_promotion", "faceoff_dot_promotion", "tracker_readings"])
def test_payloads_are_parsed_once(spark, name):
    """A filter on parts of a parsed payload does not parse it again for each part."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1


def test_players_meet_no_table(spark, tmp_path):
    """Exploded players are many times the size that is estimated, so they take part in no join; rows of one key are one
    player, whose saves are null unless all of them are a goalie's, and keys with missing parts stay apart."""
    import duckdb

    lines = [(1, 5, 7, 1, "R"), (1, 5, 7, 1, "R"), (1, 5, 8, 2, "R"), (1, 5, 8, 2, "N"), (1, 6, 8, 3, "N"), (2, None, 5, 1, "R"), (2, 5, None, 1, "N"), (2, 5, 7, 4, None), (2, 5, 7, 4, "R"), (3, 5, 7, 1, "R")]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"
    tables = {
        "lineitem": spark.createDataFrame([(*r, s, 12.0) for r in lines for s in "FO"], kind),
        "orders": spark.createDataFrame([(k, 4, "F", "1-URGENT") for k in (1, 2)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("2024-01-02").cast("timestamp")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = registry.QUERIES["payload_players"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.SQL['payload_players']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) == 12
    assert len(re.findall(r"\bJoin ", got._jdf.queryExecution().optimizedPlan().toString())) == 1
