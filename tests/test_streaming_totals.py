"""Totals kept in state: repeated, late and unreadable lines, and the cost of a batch."""

import json

from statforge.streaming.totals import follow


def line(title, match, result="WIN", score="1", day=1):
    payload = "{" if result is None else json.dumps({"result": result, "score": score})
    return {"title": title, "match_id": match, "payload": payload, "seen_at": f"2024-01-{day:02d}T00:00:00Z"}


def send(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def rows_read(query):
    return sum(p.numInputRows for p in query.recentProgress)


def totals(spark, root):
    return {r.title: (r.gp, r.score, r.wins) for r in spark.read.parquet(str(root / "totals")).collect()}


def test_repeats_late_rows_and_faults(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    first = [line(1, 1), line(1, 1), line(1, 2, "LOSS", ""), line(2, 1, score=None), line(2, 2, None), line(2, 3, score="x"), line(None, 4, score="5")]
    untimed = {**line(1, 7), "seen_at": None}
    send(source, "a", [*first, untimed])
    follow(spark, str(source), str(root))
    want = {1: (2, 1, 1), 2: (1, 0, 1), None: (1, 5, 1)}
    assert totals(spark, root) == want
    send(source, "b", first[::-1])
    follow(spark, str(source), str(root))
    assert totals(spark, root) == want
    assert sorted((r.match_id, r.problem) for r in spark.read.parquet(str(root / "quarantine")).collect()) == [(2, "no payload"), (3, "score is no number")]
    assert [r.match_id for r in spark.read.parquet(str(root / "untimed")).collect()] == [7]
    send(source, "c", [line(1, 3, day=20)])  # moves the watermark to the 13th
    follow(spark, str(source), str(root))
    send(source, "d", [line(1, 9, day=2), *first])
    send(source, "e", [line(2, 5, score="4", day=21)])
    follow(spark, str(source), str(root))
    assert totals(spark, root) == {1: (3, 2, 2), 2: (2, 4, 2), None: (1, 5, 1)}


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    for n in range(5):
        send(source, str(n), [line(n % 2, n * 10 + i) for i in range(10)])
        done = follow(spark, str(source), str(root))
        assert [rows_read(done[q]) for q in ("raw", "totals", "quarantine")] == [10, 10, 10]
    assert totals(spark, root) == {0: (30, 30, 30), 1: (20, 20, 20)}


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    follow(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "totals").exists()
