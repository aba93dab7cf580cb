"""Times between two milliseconds: what has passed counts, in queries as in their SQL."""

import datetime as dt

from answerscope.queries import ORACLES, QUERIES

from . import oracle

BASE = dt.datetime(2024, 1, 1)


def events(spark, tmp_path, *seconds):
    rows = [(k, BASE + dt.timedelta(microseconds=round(s * 1e6)), 1, "view", 1.0) for k, s in enumerate(seconds)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    return con


def test_debounced(spark, tmp_path):
    con = events(spark, tmp_path, 0, 7199.9996, 7200)
    df = QUERIES["debounced"](spark, str(tmp_path))
    assert oracle.compare(df, con, ORACLES["debounced"]) == 2
    assert {r["event_id"] for r in df.collect()} == {0, 2}


def test_debounced_stream(spark, tmp_path):
    con = events(spark, tmp_path, 0, 7199.9996, 7200)
    assert oracle.compare(QUERIES["debounced_stream"](spark, str(tmp_path)), con, ORACLES["debounced_stream"]) == 2


def test_run_durations(spark, tmp_path):
    con = events(spark, tmp_path, 0.2, 61.9997)
    df = QUERIES["run_durations"](spark, str(tmp_path))
    assert oracle.compare(df, con, ORACLES["run_durations"]) == 1
    assert [r["took"] for r in df.collect()] == ["0:01:01"]
