"""Writers, importers, health and payload faults."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statforge.operators.evidence import whole_number
from statforge.operators.payloads import match_rows, parsed_matches, player_rows
from statforge.sources.tables import filled_keys, read_documents, reported, reviewed_records, write_sidecars
from statforge.streaming.ingest import health, windowed_counts


def test_filled_keys(spark):
    t = spark.createDataFrame([(1, None), (1, 7), (2, None)], "match_id long, run_id long")
    got = filled_keys({"a": t, "b": t.limit(0)}, "match_id", 1, "run_id", 9)
    assert sorted(map(tuple, got["a"].collect()), key=repr) == sorted([(1, 9), (1, 7), (2, None)], key=repr) and got["b"].count() == 0


def test_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", [1, 2]), (2, "y", [])], "reel long, kind string, segments array<long>")
    write_sidecars(rows, str(tmp_path / "s"), ["reel"])
    write_sidecars(rows.filter("reel = 2").withColumn("kind", F.lit("z")), str(tmp_path / "s"), ["reel"])
    assert {(r.reel, r.kind) for r in spark.read.json(str(tmp_path / "s")).collect()} == {(1, "x"), (2, "z")}


def test_reports(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "id long, note string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "id long, note string")
    assert sorted(map(tuple, reported(stored, new, ["id"], force=True).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    assert reported(stored, new.filter("id = 3"), ["id"]).count() == 3
    with pytest.raises(PySparkException, match="stored already for 2"):
        reported(stored, new, ["id"]).collect()


@pytest.mark.parametrize("wrapped", [False, True])
def test_reviewed(spark, tmp_path, wrapped):
    records = [{"gamertag": "a", "games": "3"}, {"gamertag": " ", "games": "3"}, {"gamertag": "b", "games": "x"}, {"gamertag": "c"}, {"gamertag": "d", "games": 4}]
    (tmp_path / "r.json").write_text(json.dumps({"records": records} if wrapped else records))
    good, refused = reviewed_records(spark, str(tmp_path / "r.json"), ["gamertag"], {"games": "int"})
    assert sorted((r.gamertag, r.games) for r in good.collect()) == [("a", 3), ("c", None), ("d", 4)]
    assert sorted(r.reason for r in refused.collect()) == ["missing: gamertag", "no number: games"]


def test_documents_of_a_version(spark, tmp_path):
    for i, v in enumerate(["1", "2", "1"]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"version": v, "n": i}, indent=1))
    schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("n", T.LongType())])
    assert read_documents(spark, f"{tmp_path}/*.json", schema).count() == 3
    assert {r.n for r in read_documents(spark, f"{tmp_path}/*.json", schema, version="1").collect()} == {0, 2}


def test_health(spark):
    now = datetime.datetime.now(datetime.UTC)
    runs = lambda *x: spark.createDataFrame([(s, t) for s, t in x], "status string, finished_at timestamp")
    ago = lambda m: now - datetime.timedelta(minutes=m)
    assert health(runs(("failed", now), ("success", None))).first().status == "degraded"
    assert health(runs(("success", ago(90)), ("failed", now))).first().status == "stale"
    assert health(runs(("success", ago(5)), ("success", ago(90)))).first().status == "ok"


def test_windowed_counts(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(spark, str(tmp_path / "e"), source.schema).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = source.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in want.collect()}


def test_payload_faults(spark):
    club = {"score": "3", "result": "2"}
    good = {"matchId": "m", "timestamp": 1_700_000_000_000, "clubs": {"1": club, "2": {"goals": "1", "winnerByGoalieDnf": "1"}}, "players": {"1": {"k": {"position": "goalie", "glsaves": "4", "teamSide": "1"}}}}
    bad = [{**good, "matchId": ""}, {**good, "timestamp": None}, {**good, "clubs": {"3": club}}, {**good, "clubs": {"1": club}}]
    rows = spark.createDataFrame([(json.dumps(p),) for p in [good, *bad]] + [("{",), (None,)], "payload string")
    parsed = parsed_matches(rows, F.lit("1"))
    assert sorted(r.problem for r in parsed.filter("problem IS NOT NULL").collect()) == ["no matchId"] * 3 + ["no opponent club", "no timestamp", "our club is not in the match"]
    m = match_rows(parsed).first()
    assert (m.result, m.score_for, m.score_against, m.was_home, m.opponent_name, m.faceoff_pct) == ("DNF", 3, 1, False, "2", None)
    p = player_rows(parsed).first()
    assert (p.is_goalie, p.saves, p.goals_against, p.goals, p.toi_seconds) == (True, 4, 0, 0, None)
    good["players"]["1"]["k"]["skgoals"] = "three"
    with pytest.raises(PySparkException, match="expected a whole number"):
        player_rows(parsed_matches(spark.createDataFrame([(json.dumps(good),)], "payload string"), F.lit("1"))).collect()


def test_whole_number(spark):
    df = spark.createDataFrame([(None,), ("",), (" 12 ",)], "x string")
    assert [r[0] for r in df.select(whole_number(F.col("x"))).collect()] == [0, 0, 12]
