"""Order-dependent operators against plain versions on random sequences."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statforge.operators.classify import classified, fitted
from statforge.operators.screens import aligned_subjects
from statforge.operators.clusters import MedianClusters, median_clusters
from statforge.operators.decoding import best_paths, decoded, emissions, units, viterbi
from statforge.operators.matching import greedy_assignment, greedy_pairs, nearest_assignment
from statforge.operators.segments import hysteresis_segments, segments_of
from statforge.operators.sequences import collision_groups, reel_groups, reels_of

STATES = ["a", "b", "c"]


def sequences(seed, n=12, most=30):
    r = random.Random(seed)
    return {k: [r.choice(STATES) for _ in range(r.randint(1, most))] for k in range(n)}


def frame(spark, found):
    return spark.createDataFrame([(k, i, s, float(i)) for k, x in found.items() for i, s in enumerate(x)], "k long, i long, s string, t double").repartition(5)


def test_reels(spark):
    found = sequences(1, 40)
    got = {(r.k, r.reel): (r.first_segment, r.last_segment, r.segments, r.has_opener, r.has_closer) for r in reel_groups(frame(spark, found), "k", "i", "s", {"a"}, {"b"}).collect()}
    want = {}
    for k, x in found.items():
        for reel, part in itertools.groupby(enumerate(reels_of(x, {"a"}, {"b"})), key=lambda p: p[1]):
            places = [i for i, _ in part]
            own = [x[i] for i in places]
            want[k, reel] = (places[0], places[-1], len(places), "a" in own, "b" in own)
    assert got == want


@pytest.mark.parametrize("bits", [10, 2, 0])
def test_segments(spark, bits):
    """Cuts after every 1,024th frame, every fourth and every one."""
    found = sequences(2, 30, 60)
    found |= {100 + k: [r.choice(["a", "b"]) for _ in range(40) for r in [random.Random(k)]] * 2 for k in range(3)}
    found |= {200 + k: [x for _ in range(12) for x in [random.Random(k * 50 + _).choice(["a", "b", "unknown", None])] * random.Random(k * 70 + _).randint(1, 6)] for k in range(12)}
    rules = {"outliers": 1 + bits // 5, "opening_by": {"b": 2}, "shortest_by": {"b": 4.5}}
    got = sorted((r.k, r.segment, r.state, r.first_s, r.last_s, r.end_s, r.frames) for r in hysteresis_segments(frame(spark, found), "k", "i", "s", "t", STATES, bits=bits, **rules).collect())
    want = [(k, n, s, float(a), float(b), b + 1.0, b - a + 1) for k, x in found.items() for n, (s, a, b) in enumerate(segments_of(x, [float(i) for i in range(len(x))], **rules))]
    assert got == sorted(want) and len(got) > 40
    assert segments_of([], []) == []


def test_segment_rules():
    t = [float(i) for i in range(20)]
    line = lambda x: [("unknown" if c == "-" else c) for c in x]
    assert segments_of(line("aaabaa"), t) == [("a", 0, 5)]
    # the second outlier closes the segment and alone is tried as the next one's first frame
    assert segments_of(line("aaabbb"), t) == [("a", 0, 2)]
    assert segments_of(line("aaabbbb"), t) == [("a", 0, 2), ("b", 4, 6)]
    assert segments_of(line("---aaa-aa--"), t, shortest=5.5) == [("a", 3, 8)]
    assert segments_of(line("------"), t) == []


def test_viterbi(spark):
    found = sequences(3, 6, 7)
    found[0] = ["a", None, "b", "b"]
    got = {}
    for r in sorted(decoded(frame(spark, found), "k", "i", "s", STATES, stay=0.8, hit=0.7, bits=1).collect()):
        got.setdefault(r.k, []).append(r.decoded)

    def chance(path, seen):
        p = 1 / 3
        for n, (a, b) in enumerate(zip(path, seen, strict=True)):
            p *= (1 if b is None else 0.7 if a == b else 0.15) * (1 if n == 0 else 0.8 if path[n - 1] == a else 0.1)
        return p

    for k, seen in found.items():
        best = max(chance(p, seen) for p in itertools.product(STATES, repeat=len(seen)))
        assert np.isclose(chance(got[k], seen), best)


@pytest.mark.parametrize("bits", [10, 3, 0])
def test_paths_do_not_depend_on_cuts(spark, bits):
    """Random emissions, forbidden moves and many ties, against one plain pass in the same units."""
    r = np.random.default_rng(9)
    names = ["w", "x", "y", "z"]
    move = np.log(r.integers(1, 4, (4, 4)) / 4)
    move[0, 3] = move[2, 1] = -np.inf
    start = np.log([0.5, 0.5, 0.25, 0.25])
    rows, want = [], []
    for k in range(9):
        e = np.log(r.integers(1, 4, (int(r.integers(1, 90)), 4)) / 4)
        path = viterbi(units(e), units(move), units(start))
        for i, row in enumerate(e):
            rows.append((k, i, f"t{i}", row.tolist()))
            want.append((k, i, f"t{i}", names[path[i]]))
    df = spark.createDataFrame(rows, "k long, i long, tag string, e array<double>").repartition(6)
    got = best_paths(df, "k", "i", "tag", F.col("e"), move, start, names, bits)
    assert got.columns == ["k", "i", "tag", "decoded"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_emissions(spark):
    """Classifier, anchors and rejected frames, each number by hand."""
    rows = [(0, [-1.0, -2.0, -3.0], 2, False), (1, [-1.0, -2.0, -3.0], None, None), (2, [-1.0, -2.0, -3.0], 1, True)]
    df = spark.createDataFrame(rows, "i long, lp array<double>, seen int, reject boolean")
    got = {r.i: r.e for r in df.select("i", emissions(["a", "b", "u"], F.col("lp"), {"b": F.col("seen"), "u": F.lit(9)}, F.col("reject"), "u", weight=2.0).alias("e")).collect()}
    assert got == {0: [-2.0, 2.0, -6.0], 1: [-2.0, -4.0, -6.0], 2: [-20.0, -20.0, -19.0]}


def test_greedy(spark):
    r = random.Random(4)
    rows = [(g, a, b, float(r.randint(0, 6))) for g in range(4) for a in range(5) for b in range(10, 15) if r.random() < 0.6]
    got = sorted((x.g, x.a, x.b, x.score) for x in greedy_assignment(spark.createDataFrame(rows, "g long, a long, b long, score double"), "g").collect())
    want = []
    for g in range(4):
        left = [x for x in rows if x[0] == g]
        while left:
            best = min(left, key=lambda x: (-x[3], x[1], x[2]))
            want.append(best)
            left = [x for x in left if x[1] != best[1] and x[2] != best[2]]
    assert got == sorted(want)


def test_nearest_assignment(spark):
    """The same pairs as from all pairs of a bucket, with equal values and distances."""
    r = random.Random(14)
    sides = [[(g, i + 100 * s, float(r.randint(0, 12)) if r.random() < 0.9 else None) for g in range(6) for i in range(r.randint(0, 9))] for s in (0, 1)]
    schema = "g long, id long, value double"
    got = sorted((x.g, x.a, x.b, x.score) for x in nearest_assignment(spark.createDataFrame(sides[0], schema), spark.createDataFrame(sides[1], schema), "g").collect())
    want = []
    for g in range(6):
        own = [[(i, v) for k, i, v in side if k == g and v is not None] for side in sides]
        want += [(g, *p) for p in greedy_pairs([(-abs(x - y), a, b) for a, x in own[0] for b, y in own[1]])]
    assert got == sorted(want) and len(got) > 10
    assert nearest_assignment(spark.createDataFrame([], schema), spark.createDataFrame(sides[1], schema), "g").count() == 0


def test_median_clusters(spark):
    r = random.Random(15)
    rows = [(k, i, float(r.randint(0, 40)), r.random() * 40) for k in range(4) for i in range(150)] + [(9, 1, None, 2.0), (None, 1, 1.0, 1.0)]
    got = {(x.k, x.i): x.cluster for x in median_clusters(spark.createDataFrame(rows, "k long, i long, x double, y double").repartition(5), "k", "i", "x", "y", 6.0).collect()}
    assert (9, 1) not in got and got[None, 1] == 0
    for k in range(4):
        clusters = []
        for _, i, x, y in sorted(p for p in rows if p[0] == k):
            middle = lambda v: sorted(v)[len(v) // 2]
            near = [n for n, c in enumerate(clusters) if (middle([p[0] for p in c]) - x) ** 2 + (middle([p[1] for p in c]) - y) ** 2 < 36]
            n = near[0] if near else len(clusters)
            if not near:
                clusters.append([])
            clusters[n].append((x, y))
            assert got[k, i] == n
    assert MedianClusters(1.0).add(-3.0, 2.0) == 0


def test_collisions(spark):
    r = random.Random(5)
    rows = [(k, i, r.random() * 4, r.random() * 4) for k in range(3) for i in range(25)]
    got = {(x.k, x.i): x.bucket for x in collision_groups(spark.createDataFrame(rows, "k long, i long, x double, y double"), "k", "i", "x", "y", 1.0).collect()}
    for k in range(3):
        anchors = []
        for _, i, x, y in sorted(p for p in rows if p[0] == k):
            near = [n for n, (a, b) in enumerate(anchors) if (x - a) ** 2 + (y - b) ** 2 <= 1]
            if not near:
                anchors.append((x, y))
            assert got[k, i] == (near[0] if near else len(anchors) - 1)


def test_alignment(spark):
    truth = spark.createDataFrame([(1, 1, "amber fox 12"), (1, 2, "amber fox 1"), (1, 3, "quill"), (1, 4, ""), (2, 5, "quill")], "g long, id long, gamertag string")
    slots = spark.createDataFrame([(1, 11, "AmberFox12"), (1, 12, "amberfox"), (1, 13, "zzzzzzzzz"), (2, 14, "qu1ll-")], "g long, id long, gamertag string")
    got = {(r.g, r.id): r.slot for r in aligned_subjects(truth, slots, "g").collect()}
    assert got == {(1, 1): 11, (1, 2): 12, (1, 3): None, (1, 4): None, (2, 5): 14}


def test_classifier(spark):
    """Held-out frames of three separable screens; frames without a label are scored too."""
    r = random.Random(6)
    at = {"lobby": (0, 0), "menu": (5, 0), "score": (0, 5)}
    rows = [(i, None if i % 50 == 0 else s, at[s][0] + r.gauss(0, 1), at[s][1] + r.gauss(0, 1)) for i, s in enumerate(r.choice(list(at)) for _ in range(900))]
    df = spark.createDataFrame(rows, "i long, s string, x double, y double")
    got = {g.i: g for g in classified(fitted(df.filter("i < 600"), "s", ["x", "y"]), df.filter("i >= 600"), "i", "s").collect()}
    held = [(got[i], s) for i, s, _, _ in rows if i >= 600]
    assert len(got) == 300 and all(0 <= g.probability <= 1 for g, _ in held)
    assert sum(g.screen == s for g, s in held if s) > 0.97 * sum(s is not None for _, s in held)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_of_any_group(spark):
    """Line-ups, sides of one, a group of more than a line-up, and rows without group, id or name."""
    r = random.Random(15)
    name = lambda: r.choice([None, "", "--"]) if r.random() < 0.1 else "".join(r.choice("abC ") for _ in range(r.randint(2, 6)))
    side = lambda first: [(g, None if r.random() < 0.05 else first + i, name()) for g in (None, *range(14)) for i in range(70 if g == 13 else r.choice([0, 1, 3, 9]))]
    truth, slots = side(100), [*side(500), (3, 501, "abcab"), (3, 501, "bca")]
    want = []
    for g in {x[0] for x in truth}:
        plain = lambda rows: [(i, "".join(c for c in n.lower() if c != " ")) for k, i, n in rows if k == g and None not in (g, i, n) and n.strip("- ")]  # noqa: B023, E731
        pairs = [(-d, a, b) for a, s in plain(truth) for b, t in plain(slots) if (d := edits(s, t)) <= 3]
        slot = {a: b for a, b, _ in greedy_pairs([(float(s), a, b) for s, a, b in pairs])}
        want += [(g, i, slot.get(i)) for k, i, _ in truth if k == g]
    frames = [spark.createDataFrame(x, "g long, id long, gamertag string") for x in (truth, slots)]
    got = [tuple(x) for x in aligned_subjects(*frames, "g").select("g", "id", "slot").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] is not None for x in got) > 40


def test_alignment_of_dealt_tables_deals_nothing_again(spark):
    x = spark.range(400).selectExpr("id DIV 8 AS g", "id", "concat('tag', id) AS gamertag").repartition(6, "g")
    out = aligned_subjects(x, x.withColumn("id", F.col("id") + 1000), "g")
    assert "ENSURE_REQUIREMENTS" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("slot = id + 1000").count() == 400
