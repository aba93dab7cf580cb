import datetime as dt
import random

import pytest

from answerscope.streaming import ingest, turns
from answerscope.streaming.replay import replay


BASE = dt.datetime(2024, 1, 1)
EVENT = "run_id string, platform string, at timestamp, tie bigint, kind string, signal boolean, total bigint, reason string"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def told(run, platform, *steps, total=3):
    """Rows of a run on a platform: its start, then (seconds, kind, signal or reason)."""
    out = [(run, platform, BASE, -1, "start", False, total, None)]
    return out + [(run, platform, at(s), k, kind, x if kind == "capture" else None, None, x if kind == "failure" else None) for k, (s, kind, x) in enumerate(steps)]


def plain_turns(rows, closed, debounce, timeout):
    """The turns of one platform in one loop over its rows by time."""
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    total, began, last, out, took = rows[0][6], rows[0][2], None, [], []

    def end(t, status, reason):
        nonlocal began, last
        if status == "done":
            took.append((t - began).total_seconds() * 1000)
        began = last = t
        mean = sum(took[-10:]) / len(took[-10:]) if took else None
        out.append((len(out), status, reason, mean, None if mean is None else mean * (total - len(out) - 1)))

    for r in [*rows[1:], (None, None, closed, 0, "close", None, None, None)]:
        while len(out) < total and r[2] > began + timeout:
            end(began + timeout, "failed", "timeout")
        if len(out) == total or r[4] == "close" or r[4] == "capture" and (not r[5] or last and r[2] - last < debounce):
            continue
        end(r[2], "done" if r[4] == "capture" else "failed", r[7])
    return out


@pytest.mark.parametrize("slices", [1, 5])
def test_turns_equal_a_plain_loop(spark, slices):
    rng = random.Random(slices)
    rows = []
    for run in range(6):
        steps = [(rng.randrange(0, 900) + rng.choice([0, 0.4, 0.999]), rng.choice(["capture", "capture", "failure"]), None) for _ in range(25)]
        steps = [(s, k, rng.random() < 0.7 if k == "capture" else "tab closed") for s, k, _ in steps]
        rows += told(f"r{run}", "x", *steps, total=rng.choice([1, 4, 30]))
    df = spark.createDataFrame(rows, EVENT)
    out = replay(df, "at", lambda s: turns.turns(s, late="5 seconds"), at(1000 + 5), slices).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["ordinal"]):
        got.setdefault(r["run_id"], []).append((r["ordinal"], r["status"], r["reason"], r["avg_ms"], r["eta_ms"]))
        assert r["done"] + r["failed"] == r["ordinal"] + 1
    want = {r: plain_turns([x for x in rows if x[0] == r], at(1000), dt.timedelta(milliseconds=2500), dt.timedelta(seconds=90)) for r in {x[0] for x in rows}}
    for r in want:
        assert [x[:3] for x in got[r]] == [x[:3] for x in want[r]]
        for a, b in zip(got[r], want[r], strict=True):
            assert (a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 2 and abs(a[4] - b[4]) < 60)


def test_status_and_progress(spark):
    out = [("r", "x", 0, "done", None, 5, 1, 0, 3, 10.0, 20.0), ("r", "x", 1, "failed", "timeout", 9, 1, 1, 3, 10.0, 10.0), ("r", "y", 0, "done", None, 7, 1, 0, 1, 4.0, 0.0), ("s", "x", 0, "done", None, 7, 1, 0, 2, 4.0, 4.0)]
    outcomes = spark.createDataFrame(out, turns.OUTCOME)
    platforms = spark.createDataFrame([("r", "x", 3), ("r", "y", 1), ("s", "x", 2), ("s", "y", 2), ("t", "x", 0)], "run_id string, platform string, total bigint")
    got = {r["run_id"]: tuple(r)[1:] for r in turns.run_status(outcomes, platforms).collect()}
    assert got == {"r": (4, 2, 1, 3, 10.0), "s": (4, 1, 0, 1, None), "t": (0, 0, 0, 0, 0.0)}
    prompts = spark.createDataFrame([(p, q, k) for p, q, n in (("r", "x", 3), ("s", "y", 2)) for k in range(n)], "run_id string, platform string, ordinal bigint")
    assert [tuple(r) for r in turns.progress(prompts, outcomes).orderBy("run_id", "ordinal").collect()] == [("r", "x", 0, "done", None), ("r", "x", 1, "failed", "timeout"), ("r", "x", 2, "running", None), ("s", "y", 0, "running", None), ("s", "y", 1, "pending", None)]


def test_a_stream_of_no_rows(spark):
    df = spark.createDataFrame([], EVENT)
    assert replay(df, "at", turns.turns).count() == 0


def test_the_engine_tracks_a_run(spark, tmp_path):
    from answerscope.api import PROMPTS, Engine

    e = Engine(spark, str(tmp_path / "store"))
    e.handle("profile-save", id="p1", name="P", brand={"name": "B"}, engines=["chatgpt"])
    e.handle("prompt-save", rows=spark.createDataFrame([("q1", "p1", "one", [], True, 1), ("q2", "p1", "two", [], True, 2), ("q3", "p1", "three", [], True, 3)], PROMPTS))
    run = e.handle("run-start", profile_id="p1", now_ms=0)["result"]["id"]
    for k, rows in enumerate((told(run, "chatgpt", (30, "capture", True), (31, "capture", True)), [("", "", at(125), 9, "close", False, None, None)])):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        assert e.handle("run-track", events=stream, checkpoint=str(tmp_path / "cp"))["ok"]
    assert [tuple(r)[1:] for r in e.handle("run-status")["result"].collect()] == [(3, 1, 0, 1, 60_000.0)]
    spark.createDataFrame([("", "", at(400), 9, "close", False, None, None)], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert e.handle("run-track", events=spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), checkpoint=str(tmp_path / "cp"))["ok"]
    assert [(r["prompt_id"], r["status"], r["reason"]) for r in e.handle("run-progress", run_id=run)["result"].orderBy("ordinal").collect()] == [("q1", "done", None), ("q2", "failed", "timeout"), ("q3", "failed", "timeout")]


def test_ingest_is_idempotent(spark, tmp_path):
    from answerscope.schema import DERIVED, RAW
    from answerscope.store import Table

    from .test_payloads import sample

    raw, body = sample()
    rows = [(k, None, "https://chatgpt.com/backend-api/conversation", body, None, None, dt.datetime(2024, 1, 1), raw, None, 1) for k in ("a", "b")]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "in"))
    tables = [Table(spark, str(tmp_path / n), "capture_id", s) for n, s in (("raw", RAW), ("derived", DERIVED))]
    for k in range(2):
        stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, tables[0].upsert, tables[1].upsert, str(tmp_path / f"cp{k}")).awaitTermination()
        assert [t.stats() for t in tables] == [2, 2]
    tables[1].delete(tables[1].get("a"))
    assert tables[1].keys("captured_at", 5).collect()[0][0] == "b"


def test_weekly_windows_and_silences(spark):
    on = lambda d, h=0: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([("a", on(1)), ("a", on(7, 23)), ("a", on(8)), ("b", on(2))], "platform string, captured_at timestamp")
    got = {(r["window"]["start"].day, r["platform"]): r["captures"] for r in ingest.weekly_windows(df).collect()}
    assert got == {(1, "a"): 2, (8, "a"): 1, (1, "b"): 1}
    assert [r["timed_out"] for r in ingest.silences(df, "platform", "captured_at", "platform", 86_400_000).orderBy("captured_at").collect()] == [True, False]


def test_position_after_a_restart(spark):
    df = spark.createDataFrame([(1, 5, 3, 0), (1, 1, 3, 99_999), (2, 1, 3, 5)], "snapshot int, completed int, prompts int, elapsed int")
    from pyspark.sql import functions as F

    got = df.select(*[c.alias(n) for c, n in zip(ingest.reconcile(*map(F.col, df.columns)), ("at", "status"))]).collect()
    assert [tuple(r) for r in got] == [(3, "done"), (1, "failed"), (2, "running")]
