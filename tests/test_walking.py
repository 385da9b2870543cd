"""Nested fields, climbing rejections, hulls and anchors against plain versions."""

import json
import random

from pyspark.sql import functions as F

from statforge.operators.rink import calibrations, located
from statforge.operators.verdicts import anchors
from statforge.operators.walking import rejection_climb, walked_fields


def test_walked_fields_at_random_depths(spark):
    r = random.Random(3)

    def node(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return {"status": r.choice(["ok", None]), "confidence": r.choice([0.5, 1, None]), "value": r.choice(["a", 3, None]), "inner": {"status": "x", "confidence": 1}} if r.random() < 0.7 else r.choice([1, "s", None, []])
        if kind < 0.6:
            return [node(depth - 1) for _ in range(r.randint(0, 3))]
        return {f"k{i}": node(depth - 1) for i in range(r.randint(0, 3))}

    payloads = [(i, node(r.randint(0, 6))) for i in range(60)]

    def walk(v, path):
        if isinstance(v, dict):
            if "status" in v and "confidence" in v:
                text = None if v.get("value") is None else str(v["value"])
                yield path, text, v["confidence"], v["status"] or "missing"
            else:
                for k, x in v.items():
                    yield from walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{path}[{i}]")

    rows = [(i, json.dumps(v)) for i, v in payloads] + [(900, None), (901, "{not json"), (902, "")]
    got = sorted((x.id, x.path, str(x.value), str(x.confidence), x.status) for x in walked_fields(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect())
    want = sorted((i, p, str(v), str(None if c is None else float(c)), s) for i, x in payloads for p, v, c, s in walk(x, "$"))
    assert got == want and len(want) > 40


def test_rejection_climbs_random_trees(spark):
    r = random.Random(4)
    parents = {i: None if i < 5 else r.randrange(max(0, i - 20), i) for i in range(120)}
    bad = {i: r.random() < 0.7 for i in parents if i not in parents.values()}
    rows = [(i, p, bad.get(i)) for i, p in parents.items()]
    got = {x.id: (x.rejected, x.round) for x in rejection_climb(spark.createDataFrame(rows, "id long, parent long, rejected boolean").repartition(3)).collect()}

    def falls(i):
        children = [c for c, p in parents.items() if p == i]
        if not children:
            return (True, 0) if bad[i] else (False, None)
        each = [falls(c) for c in children]
        return (True, 1 + max(n for _, n in each)) if all(f for f, _ in each) else (False, None)

    assert got == {i: falls(i) for i in parents}
    assert any(n and n > 1 for _, n in got.values())


def test_hull_and_zones(spark):
    """A square of landmarks: corners, edges, outside, both directions of play."""
    marks = [(1, 100, 100, -50, 25), (1, 300, 100, 50, 25), (1, 300, 200, 50, -25), (1, 100, 200, -50, -25), (1, 200, 150, 0, 0), (2, 5, 5, 1, 1), (2, 5, 9, 1, 2)]
    fits = calibrations(spark.createDataFrame([(*m[:3], float(m[3]), float(m[4])) for m in marks], "k long, pixel_x long, pixel_y long, hockey_x double, hockey_y double"), "k")
    row = fits.collect()
    assert len(row) == 1 and abs(row[0].cx - 200) < 1e-9 and abs(row[0].half_w - 200) < 1e-9
    points = [(1, 0, 200, 150), (1, 1, 300, 100), (1, 2, 100, 150), (1, 3, 301, 150), (1, 4, 900, 900), (1, 5, 260, 150), (2, 6, 5, 5)]
    got = {r.i: (r.x, r.y, r.zone, r.confidence) for r in located(spark.createDataFrame(points, "k long, i long, pixel_x long, pixel_y long"), fits, "k", F.col("i") == 5).collect()}
    assert got[0] == (0.0, 0.0, "neutral", 1.0) and got[1] == (50.0, 25.0, "offensive", 1.0) and got[2] == (-50.0, 0.0, "defensive", 1.0)
    assert got[3][2:] == ("offensive", 0.3) and got[4] == (105.0, -45.0, "offensive", 0.3) and got[5] == (-30.0, 0.0, "defensive", 1.0)
    assert 6 not in got


def test_anchor_order(spark):
    """Source, then the usual tag, then confidence or recency; fields only as a last resort."""
    rows = [
        (1, 1, "lobby", "Ann 1", "9", None), (1, 2, "loadout", "zed", "9", 0.9), (1, 3, "loadout", "ann1", None, None), (1, 4, "lobby", "ann-1", "9", None),
        (2, 5, "loadout", "bo", "1", 0.4), (2, 6, "loadout", "bo", None, 0.8), (2, 7, "loadout", "bo", "1", 0.4),
        (3, 8, "loadout", "x", "1", None), (3, 9, "loadout", "y", None, None), (3, 10, "lobby", "w", "1", None), (3, 11, "lobby", "w", "1", None), (3, 12, "lobby", "w", "1", None),
        (4, 13, "lobby", None, None, None), (4, 14, "lobby", None, "3", None), (4, 15, "lobby", None, "3", None),
        (5, 16, "lobby", "q", "1", None), (5, 17, "lobby", "q", None, None),
    ]
    df = spark.createDataFrame(rows, "slot long, id long, source string, gamertag string, number string, conf double")
    got = {r.slot: r.anchor for r in anchors(df, ["slot"], ["gamertag", "number"], "conf").collect()}
    assert got == {1: 3, 2: 6, 3: 8, 4: 14, 5: 17}
