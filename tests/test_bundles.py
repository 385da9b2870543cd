"""Subject bundles and in-run duplicates against plain versions."""

import itertools
import random

from statforge.operators.bundles import connected, deduplicated_in_order, merged_subjects, same_subject_links, subject_bundles


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def same(a, b):
    if a[0] == b[0]:
        return True
    n = min(6, len(a[0]), len(b[0]))
    if n < 3:
        return False
    far = distance(a[0][:n], b[0][:n])
    return far < 2 or (far == 2 and all(x is None or y is None or x == y for x, y in zip(a[1:], b[1:], strict=True)))


def test_bundles_against_every_pair(spark):
    r = random.Random(6)
    words = ["amber", "ambler", "quartz", "quarry", "ox", "o-x", "delta wing", "Delta 9", "deltoid", "zz", ""]
    edit = lambda w: w[: (i := r.randint(0, len(w)))] + r.choice(["", "x", "K"]) + w[i + r.randint(0, 1) :]
    rows = [(i, r.randint(0, 3), edit(r.choice(words)) if r.random() < 0.95 else None, r.choice([None, 1, 2]), r.choice([None, None, 7, 8])) for i in range(160)]
    got = {x.id: x.bundle for x in subject_bundles(spark.createDataFrame(rows, "id long, g long, gamertag string, position long, jersey long").repartition(4), "g").collect()}
    tag = {i: ("".join(c for c in (t or "").lower() if c.isalnum()), p, j) for i, _, t, p, j in rows}
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(rows, 2):
        if a[1] == b[1] and same(tag[a[0]], tag[b[0]]):
            x, y = sorted((top(a[0]), top(b[0])))
            root[y] = x
    assert got == {i: top(i) for i in root} and 4 < len(set(got.values())) < 100


def test_connected_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)]
    got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_merged_subjects(spark):
    rows = [(1, "ann", 2, None, 0.5), (2, "anne", 3, 7, 0.9), (3, "an", 2, 8, None), (4, "bo", None, None, None)]
    bundles = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, bundle long")
    got = {x.bundle: (x.gamertag, x.position, x.jersey, x.frames) for x in merged_subjects(spark.createDataFrame(rows, "id long, gamertag string, position long, jersey long, confidence double"), bundles).collect()}
    assert got == {1: ("anne", 2, 7, 3), 4: ("bo", None, None, 1)}


def test_events_one_row_at_a_time(spark):
    r = random.Random(7)
    name = lambda: r.choice(["amber", "ambr", "amberr", "quartz", "-. Quartz (C)", "o", "", None])
    event = lambda i: (i, r.randint(0, 2), r.choice(["goal", None]), r.choice([None, None, 1, 2]), name(), r.choice([None, 1.2, 1.4, 9.5]), r.choice([None, 3.0]), r.randint(0, 50))
    stored, incoming = [event(i) for i in range(12)], [event(100 + i) for i in range(120)]
    schema = "id long, m long, kind string, actor_id long, actor string, x double, y double, n long"
    got = {x.id: (x.outcome, list(x.candidates)) for x in deduplicated_in_order(spark.createDataFrame(stored, schema), spark.createDataFrame(incoming, schema).repartition(5), ["m", "kind"], "n").collect()}
    clean = lambda a: {"-. Quartz (C)": "quartz", None: ""}.get(a, a)
    there, want = [e for e in stored], {}
    spot = lambda e: None if e[5] is None or e[6] is None else (int(e[5] + 0.5), int(e[6] + 0.5))
    for e in sorted(incoming, key=lambda e: (e[7], e[0])):
        bucket = [s for s in there if s[1:3] == e[1:3]]
        found = [s for s in bucket if e[3] is not None and s[3] == e[3]]
        if not found and clean(e[4]):
            found = [s for s in bucket if clean(s[4]) and distance(clean(s[4]), clean(e[4])) <= 1]
        if spot(e):
            found = [s for s in found if spot(s) in (None, spot(e))]
        want[e[0]] = ("insert" if not found else "hit" if len(found) == 1 else "ambiguous", sorted(s[0] for s in found))
        if not found:
            there.append(e)
    assert got == want and len({o for o, _ in got.values()}) == 3


def test_links_broadcast_nothing(spark, tmp_path):
    """Exploded keys are many times the size that is estimated, so no side may be sent to the driver."""
    rows = spark.createDataFrame([(1, 1, "amber", None, 1), (2, 1, "ambler", 2, 1), (3, 2, "amber", 3, None)], "id long, g long, tag string, position long, jersey long")
    rows.write.parquet(f"{tmp_path}/rows")
    links = same_subject_links(spark.read.parquet(f"{tmp_path}/rows"), "g")
    assert [tuple(r) for r in links.filter("u <> v").collect()] == [(1, 2)]
    assert "Broadcast" not in links._jdf.queryExecution().toString()
