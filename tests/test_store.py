import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from answerscope import store
from answerscope.api import PROMPTS, RUNS, Engine
from answerscope.files import Conflict
from answerscope.store import Table

SCHEMA = "k string, at bigint, v string"


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, str(tmp_path / "t"), "k", SCHEMA, 8, "at")


def test_equal_keys_of_a_batch_leave_the_newest(spark, table):
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 0, "m")], SCHEMA))
    assert rows_of(table) == [("a", 3, "y"), ("b", 0, "m")]
    table.upsert(spark.createDataFrame([("a", 0, "again")], SCHEMA))
    assert rows_of(table) == [("a", 0, "again"), ("b", 0, "m")]
    table.upsert(spark.createDataFrame([("c",)], "k string"))
    table.upsert(spark.createDataFrame([], SCHEMA))
    assert ("c", None, None) in rows_of(table) and table.stats() == 3


def test_a_killed_write_blocks_nothing(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    monkeypatch.setattr(table._files, "claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(spark.createDataFrame([("a", 2, "lost"), ("b", 1, "lost")], SCHEMA))
    monkeypatch.undo()
    assert rows_of(table) == [("a", 1, "x")]
    table.upsert(spark.createDataFrame([("b", 1, "y")], SCHEMA))
    assert rows_of(table) == [("a", 1, "x"), ("b", 1, "y")]


def test_a_change_rewrites_only_touched_buckets(spark, table):
    table.upsert(spark.range(200).selectExpr("cast(id as string) k", "id at", "'x' v"))
    before = table._state()[1]
    table.upsert(spark.createDataFrame([("7", 7, "new")], SCHEMA))
    after = table._state()[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    table.delete(spark.createDataFrame([("7",)], "k string"))
    assert table.stats() == 199 and len(table.versions()) == 3
    for k in range(4):
        table.upsert(spark.createDataFrame([("n", k, "v")], SCHEMA))
    assert len(table.versions()) == Table.KEPT and table.stats() == 200
    named = {x.split("/")[1] for x in table._state()[1].values()}
    assert named <= set(table._files.names("data")) and len(table._files.names("data")) <= len(named) + Table.KEPT
    table.clear()
    assert table.stats() == 0


def test_concurrent_changes_are_all_kept(spark, tmp_path):
    new = lambda: Table(spark, str(tmp_path / "t"), "k", SCHEMA)
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda k: new().upsert(spark.createDataFrame([(str(k), k, "v")], SCHEMA)), range(8)))
    assert [r[0] for r in rows_of(new())] == [str(k) for k in range(8)]
    with pytest.raises(Conflict):
        new()._files.claim(f"versions/v{new().versions()[-1]}.json", {})


def test_state_survives_a_restart(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.handle("settings-set", my_brand="Globex", retention_max=70)
    e.handle("profile-save", id="p1", name="P", brand={"name": "Globex"}, locked=True)
    assert "locked" in e.handle("profile-save", id="p1", name="Q", brand={})["error"] and e.handle("profile-save", id="p1", name="Q", brand={"name": "Globex"}, override=True)["ok"]
    e.handle("prompt-save", rows=spark.createDataFrame([("1", "p1", "one", [], True, 1)], PROMPTS))
    run = e.handle("run-start", profile_id="p1", now_ms=5)["result"]
    again = Engine(spark, str(tmp_path))
    assert again.settings.my_brand == "Globex" and again.settings.retention_max == 70 and again.profiles.rows["p1"].name == "Q" and again.profiles.rows["p1"].last_run_at == 5
    assert "in progress" in again.handle("run-start", profile_id="p1")["error"]
    with ThreadPoolExecutor(3) as pool:
        assert all(r["ok"] for r in pool.map(lambda k: Engine(spark, str(tmp_path)).handle("run-sync", run_id=run["id"], captured=1, failed=3, reason="timeout"), range(3)))
    again.handle("run-sync", run_id=run["id"], captured=1, failed=4, reason="closed", count=2, status="finished", now_ms=9)
    got = again.handle("run-list")["result"].collect()
    assert len(got) == 1 and got[0]["reasons"] == {"timeout": 3, "closed": 2} and (got[0]["status"], got[0]["failed"], got[0]["finished_at"]) == ("finished", 4, 9)
    report = again.handle("diagnostics")["result"]
    assert "finished · chatgpt+gemini · 1/2 captured, 4 failed · took 0 s" in report and "reasons: closed: 2, timeout: 3" in report and "one" not in report
    assert again.handle("run-start", profile_id="p1", now_ms=10)["ok"]
    again.handle("tag-add", prompt_id="1", tag=" new ")
    assert [r["tags"] for r in again.handle("prompt-filter", profile_id="p1", search="ONE", tags=("new",))["result"].collect()] == [["new"]]
    assert again.handle("prompt-filter", profile_id="p1", untagged=True)["result"].count() == 0
    assert again.handle("clear-all")["ok"] and again.runs.stats() == 0 and again.prompts.stats() == 1


def test_saving_a_profile_merges_over_the_old_one(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.handle("profile-save", id="a", name="A", brand={"name": "B"}, competitors=[{"name": "C"}], created_at=7)
    assert e.handle("profile-save", id="a", name="New")["ok"]
    p = Engine(spark, str(tmp_path)).profiles.rows["a"]
    assert (p.name, p.brand, p.competitors, p.created_at) == ("New", {"name": "B"}, [{"name": "C"}], 7)


def test_the_debug_log_keeps_its_newest(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    for k in range(3):
        e.handle("debug", rows=spark.range(k * 90, k * 90 + 90).selectExpr("cast(id as string) id", "id at", "'x' event"))
    assert e.log.stats() == 200 and [r["at"] for r in e.handle("get-debug")["result"].collect()] == list(range(150, 270))
    assert e.handle("clear-debug")["ok"] and e.log.stats() == 0


def test_what_cannot_be_read_is_kept_aside(spark, tmp_path, monkeypatch):
    from answerscope.schema import RAW
    from answerscope.sources import payloads

    from .test_payloads import sample

    e = Engine(spark, str(tmp_path))
    raw, body = sample()
    row = lambda k, r: (k, None, "https://chatgpt.com/backend-api/conversation", body, None, None, dt.datetime(2024, 1, 1), r, None, 1)
    e.handle("raw-conversation", rows=spark.createDataFrame([row("a", raw), row("b", raw)], RAW))
    real = payloads.ADAPTERS["chatgpt"]

    def failing(text, *rest):
        if text.endswith("broken"):
            raise ValueError("no payload")
        return real(text, *rest)

    monkeypatch.setitem(payloads.ADAPTERS, "chatgpt", failing)
    e.raw.upsert(spark.createDataFrame([row("a", raw + "broken")], RAW).withColumn("platform", F.lit("chatgpt")))
    e.raw.upsert(e.raw.get("b").withColumn("page_url", F.lit("new")))
    assert e.handle("reprocess-all")["result"] == {"total": 2, "reprocessed": 1}
    assert [tuple(r) for r in e.handle("get-errors")["result"].collect()] == [("a", "ValueError: no payload")]
    assert {r["capture_id"]: r["page_url"] for r in e.derived.read().collect()} == {"a": None, "b": "new"}
    monkeypatch.undo()
    assert e.handle("reprocess-all")["result"] == {"total": 2, "reprocessed": 2} and e.errors.stats() == 0


def test_retention_runs_after_a_capture(spark, tmp_path):
    from answerscope.schema import RAW

    from .test_payloads import sample

    e = Engine(spark, str(tmp_path))
    raw, body = sample()
    row = lambda k: (f"c{k:03}", None, "https://chatgpt.com/backend-api/conversation", body, None, None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), raw, None, 1)
    e.handle("settings-set", retention_max=1)  # the floor is 50
    assert e.handle("raw-conversation", rows=spark.createDataFrame([row(k) for k in range(55)], RAW))["ok"]
    assert e.handle("stats")["result"] == {"raw": 50, "derived": 50}
    assert min(r["capture_id"] for r in e.derived.keys().collect()) == "c005"


def test_stamping_by_the_position_of_a_run(spark):
    runs = spark.createDataFrame([("r1", ["q1", "q2"], [["a"], None])], "run_id string, prompt_ids array<string>, prompt_tags array<array<string>>")
    prompts = store.run_prompts(runs)
    assert [(r["ordinal"], r["prompt_id"]) for r in prompts.orderBy("ordinal").collect()] == [(0, "q1"), (1, "q2")]
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    positions = spark.createDataFrame([("x", "r1", "p1", 0, at(0), at(5)), ("x", "r1", "p1", 1, at(5), None)], "platform string, run_id string, profile_id string, ordinal int, since timestamp, until timestamp")
    captures = spark.createDataFrame([("a", "x", at(1)), ("b", "x", at(5)), ("c", "y", at(1))], "capture_id string, platform string, captured_at timestamp")
    got = {r["capture_id"]: r["geo"] and tuple(r["geo"]) for r in store.stamp(captures, positions, prompts).collect()}
    assert got == {"a": ("p1", "r1", "q1", ["a"]), "b": ("p1", "r1", "q2", []), "c": None}
    assert RUNS
