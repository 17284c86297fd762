import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.streaming import consensus as s


@pytest.fixture
def folder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=37 * i), i % 5, ("click", "purchase", "view")[i % 3], float(i), "{}") for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for k in range(3):
        df.where(f"event_id div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
        (tmp_path / "events").mkdir(exist_ok=True)
        next((tmp_path / "in" / f"p{k}").glob("part-*.parquet")).rename(tmp_path / "events" / f"{k}.parquet")
    return tmp_path, df


def test_windows_equal_batch(spark, folder):
    path, df = folder
    got = s.run_to_table(s.windowed(s.events_stream(spark, f"{path}/events"), "1 hour"), "w1", "complete", f"{path}/c1")
    want = df.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got.count() == want.count() and got.agg(F.sum("packets")).first()[0] == 300


def test_sessions_and_rounds(spark, folder):
    path, df = folder
    got = s.run_to_table(s.proposal_rounds(s.events_stream(spark, f"{path}/events")), "r1", "update", f"{path}/c2")
    last = got.groupBy("round", "validator").agg(F.max("proposals").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == 300
    got = s.run_to_table(s.sessions(s.events_stream(spark, f"{path}/events"), "10 minutes"), "s1", "append", f"{path}/c3")
    assert {"peer_id", "start", "end", "packets"} == set(got.columns)


def test_quorum_fires_once(spark, folder):
    path, _ = folder
    got = s.run_to_table(s.quorum_events(s.events_stream(spark, f"{path}/events"), 4), "q1", "append", f"{path}/c4").where("outcome = 'quorum'").collect()
    assert [(r["ledger_seq"], r["validators"]) for r in got] == [(0, 5)]


def test_distinct_validations_and_filters(spark, folder):
    path, _ = folder
    trusted = spark.createDataFrame([(0,), (1,)], "validator long")
    got = s.run_to_table(s.distinct_validations(s.events_stream(spark, f"{path}/events"), trusted, "1 day"), "d1", "append", f"{path}/c5")
    assert sorted(r["validator"] for r in got.collect()) == [0, 1]
    rows = spark.createDataFrame([("click",), ("view",)], "type string")
    assert [r["type"] for r in s.of_type(rows, "click", hide=True).collect()] == ["view"]
