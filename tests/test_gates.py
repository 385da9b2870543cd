"""The promotion gate's six steps, its invariants and the quality flags, worked by hand."""

from decimal import Decimal

import pytest

from statforge.operators.flags import collisions, quality_flags
from statforge.operators.gates import gated, leaders, violations

CANDIDATES = "match_id long, slot long, field string, evidence_id long, value string, confidence double"
SLOTS = "match_id long, slot long, team_side string, is_captain boolean"


def candidates(spark, *rows):
    return spark.createDataFrame([(1, 1, f, i, v, c) for i, (f, v, c) in enumerate(rows)], CANDIDATES)


@pytest.mark.parametrize(
    ("rows", "known", "want"),
    [
        ([], None, ("unobserved", None, None, 0)),
        ([("build", "a", 0.9)], None, ("promoted", "a", 0.9, 0)),
        ([("build", "a", 0.9), ("build", "a", 0.9)], None, ("promoted", "a", 0.9, 0)),  # the same value is no rival
        ([("build", "a", 0.9), ("build", "b", 0.7)], None, ("contested", None, None, 1)),
        ([("build", "a", 0.9), ("build", "b", 0.6)], None, ("promoted", "a", 0.9, 1)),
        ([("build", "a", 0.5), ("build", "b", 0.49)], None, ("promoted", "a", 0.5, 0)),  # a rival below the threshold
        ([("build", "a", None), ("build", "b", None)], None, ("promoted", "a", 0.0, 0)),
        ([("build", "b", 0.9), ("build", None, 0.8)], None, ("contested", None, None, 1)),
        ([("build", "a", 0.9), ("build", "b", 0.7)], "b", ("overruled", None, None, 1)),
        ([("build", "a", 0.9)], "a", ("promoted", "a", 0.9, 0)),
        ([("build", "z", 0.9)], "a", ("invalid", None, None, 0)),
        ([("build", None, 0.9)], None, ("invalid", None, None, 0)),
    ],
)
def test_gate(spark, rows, known, want):
    read = candidates(spark, *rows)
    best = leaders(read)
    slots = spark.createDataFrame([(1, 1, "for", False)], SLOTS)
    expected = spark.createDataFrame([(1, 1, "build")], "match_id long, slot long, field string")
    authority = spark.createDataFrame([(1, 1, "build", known)] if known else [], "match_id long, slot long, field string, known string")
    r = gated(expected, best, violations(read, best, slots, ["a", "b"]), authority).first()
    assert (r.status, r.value, r.confidence, r.conflicts) == want


def failing(spark, rows, slots=((1, 1, "for", False),)):
    read = candidates(spark, *rows)
    return {(r.field, r.violation) for r in violations(read, leaders(read), spark.createDataFrame(list(slots), SLOTS), ["a"]).collect()}


def test_invariants(spark):
    assert failing(spark, [("number", "7.5", 1.0)]) == {("number", "not a number")}
    assert failing(spark, [("number", "100", 1.0)]) == failing(spark, [("number", "-1", 1.0)]) == {("number", "no such number")}
    assert failing(spark, [("number", "0", 1.0)]) == failing(spark, [("number", "99", 1.0), ("number", "x", 0.9)]) == set()
    assert failing(spark, [("gamertag", " CPU ", 1.0)]) == failing(spark, [("gamertag", None, 1.0)]) == {("gamertag", "no player's tag")}
    assert failing(spark, [("gamertag", "CPU", 1.0), ("build", "a", 0.5)]) == set()
    assert ("gamertag", "no player's tag") in failing(spark, [("gamertag", "CPU", 1.0), ("build", "a", 0.4)])
    assert failing(spark, [("trait", "x", 0.1)] * 3) == set()
    assert failing(spark, [("trait", "x", 0.1)] * 3 + [("trait", "y", 0.1)]) == {("trait", "traits: 4")}
    assert failing(spark, [("trait", "x", 0.1), ("trait", None, 0.9), ("trait", "z", 0.0), ("trait", "w", None)]) == {("trait", "traits: 1")}
    assert failing(spark, [("attribute", str(i), 0.2) for i in range(19)]) == {("attribute", "attributes: 19")}
    assert failing(spark, [("attribute", str(i), 0.2) for i in range(20)]) == set()
    assert failing(spark, [], [(1, 1, None, True), (1, 2, None, True)]) == {("team_side", "no side")}
    assert failing(spark, [], [(1, 1, "for", True), (1, 2, "for", True), (1, 3, "against", True), (1, 4, "for", None)]) == {("is_captain", "captains: 2")}
    assert failing(spark, [], []) == set()


EVENTS = "match_id long, period long, clock string, kind string, side string, actor_tag string, actor_id long, target_id long, x decimal(8,2), y decimal(8,2)"


def event(**values):
    base = {"match_id": 1, "period": 1, "clock": None, "kind": "shot", "side": "against", "actor_tag": "a"} | values
    return tuple(Decimal(str(base[n])) if n in "xy" and n in base else base.get(n) for n in (c.split()[0] for c in EVENTS.split(", ")))


def flagged(spark, events, pim=0, recorded=(), lineup=((1, 5),)):
    make = spark.createDataFrame
    rows = quality_flags(make(events, EVENTS), make([(1, pim)], "match_id long, pim long"), make([(m,) for m in recorded], "match_id long"), make(list(lineup), "match_id long, player_id long"))
    return {(r.flag, r.rule): (r.n, r.severity) for r in rows.collect()}


def test_flags(spark):
    assert flagged(spark, []) == {}
    assert flagged(spark, [event(clock="1:00")] * 6) == {("A", "repeated"): (5, "warn")}
    assert flagged(spark, [event(clock="1:00")] * 7) == {("A", "repeated"): (6, "fail")}
    assert flagged(spark, [event(side="for")] * 6) == {("B", "unresolved"): (6, "fail")}
    assert flagged(spark, [event(actor_tag=None), event(actor_tag=None, kind="faceoff")]) == {("B", "unread"): (1, "warn")}
    assert flagged(spark, [event()], pim=4) == {("D", "penalties"): (4, "warn")}
    assert flagged(spark, [event()], pim=4, recorded=[1, 1]) == {("D", "penalties"): (4, "fail")}
    assert flagged(spark, [event(kind="penalty")], pim=4, recorded=[1]) == {}
    assert flagged(spark, [event(actor_id=5, target_id=6), event(target_id=6)]) == {("G", "target"): (2, "fail")}
    assert flagged(spark, [event(actor_id=5)], lineup=()) == {("G", "actor"): (1, "fail")}


def test_collisions_against_brute_force(spark):
    points = [(p, round((i * 37 % 90) / 20 - 2, 2), round((i * i % 70) / 20 - 1, 2)) for i in range(120) for p in (1, 2)] + [(1, 0, 0)] * 4 + [(1, 1, 1), (1, -1, 1), (2, 0, 0)]
    rows = [event(period=p, x=x, y=y) for p, x, y in points] + [event(), event()]
    exact = [(p, Decimal(str(x)), Decimal(str(y))) for p, x, y in points]
    want = sum(a[0] == b[0] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1 for i, a in enumerate(exact) for b in exact[:i])
    assert collisions(spark.createDataFrame(rows, EVENTS)).first().n == want
