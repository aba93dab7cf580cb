"""Every query with an oracle against DuckDB on the smallest tables."""

import re

import pytest

from answerscope.queries import ORACLES, QUERIES

from . import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, con, name):
    oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])


def test_timelines_cover_all_prompts(spark, sf_dir, con):
    """Prompts of any key and any number of captures."""
    want = {r[0]: r[1] for r in con.execute("select lower(c_name), count(distinct o_orderkey) from orders join lineitem on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where o_custkey in (select o_custkey from orders group by 1 having count(*) > 1) group by 1").fetchall()}
    sizes = {r["prompt_key"]: r["points"] for r in QUERIES["timeline_matrix"](spark, sf_dir).select("prompt_key", "points").distinct().collect()}
    assert set(sizes) == set(want) and len(set(sizes.values())) > 3


@pytest.mark.parametrize("name", ["url_leaderboard", "source_leaderboard", "timeline_headline"])
def test_joins_follow_the_size_of_the_input(spark, sf_dir, con, name, monkeypatch):
    """No shuffle of lines or records has the session's number of partitions, so that a task's part does not grow with the input."""
    from answerscope import files

    monkeypatch.setattr(files, "PIECE", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(([a-z_]+)#\d+L?, (\d+)\)", plan)
        assert {k for k, _ in dealt} >= {"l_orderkey", "l_partkey", "l_suppkey", "o_custkey", "c_custkey", "o_orderkey"}
        # The sums of a leaderboard are already one row a key and task.
        assert [x for x in dealt if int(x[1]) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and x[0] not in ("key", "domain", "url")] == []
        oracle.compare(df, con, ORACLES[name])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_and_bulk_add_cover_all_rows(spark, sf_dir, con):
    count = lambda sql: con.execute(sql).fetchone()[0]
    assert QUERIES["csv_escape"](spark, sf_dir).count() == count("select count(*) from documents")
    assert QUERIES["bulk_add_dupes"](spark, sf_dir).count() == count("select count(*) from part where p_partkey % 2 = 1")


def test_stored_records_give_the_same(spark, sf_dir, con, tmp_path):
    from answerscope.plans import tpch

    tpch.store_responses(spark, sf_dir, str(tmp_path / "records"))
    try:
        for name in ("brand_metrics", "overview", "timeline_delta", "audit_log"):
            oracle.compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    finally:
        tpch.STORED.clear()
