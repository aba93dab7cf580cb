import datetime as dt

import pytest
from pyspark.sql import functions as F

from answerscope.functions import text as T
from answerscope.operators import dashboards as D
from answerscope.operators import metrics as M
from answerscope.sources import exports


def test_retention_is_exact_with_ties_and_nulls(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k // 3)) for k in range(3000)] + [(3000 + k, None) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    got = sorted(r["id"] for r in D.retention(df, 1000, "ts", "id").collect())
    assert got == list(range(2000, 3000))
    assert D.retention(df, 3002, "ts", "id").count() == 3002 and D.retention(df, 10**6, "ts", "id").count() == 3005
    assert D.retention(df.limit(40), 1, "ts", "id").count() == 40  # the floor


def test_ranks_without_one_order_of_all(spark):
    rows = [(str(k), [(f"u{d}", f"d{d:02}", "cited" if (k + d) % 2 else "fetched") for d in range(k % 7 + 1)]) for k in range(60)]
    df = spark.createDataFrame(rows, "capture_id string, sources array<struct<url:string,domain:string,outcome:string>>")
    got = D.source_analysis(df).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 8))
    assert [r["domain"] for r in got] == [r["domain"] for r in sorted(got, key=lambda r: (-r["cited"], -r["total"], r["domain"]))]
    assert abs(sum(r["cited_share"] for r in got) - 100) < 1e-9


def test_matrix_pivots_captures(spark):
    points = spark.createDataFrame([("p", "a", 1, 2), ("p", "b", 2, 2)], "prompt_key string, capture_id string, ordinal int, points int")
    values = spark.createDataFrame([("p", "a", "x", 2), ("p", "b", "x", 5), ("p", "b", "y", 1)], "prompt_key string, capture_id string, name string, value long")
    assert sorted(map(tuple, D.matrix(points, values.drop("prompt_key").withColumn("prompt_key", F.lit("p")), 2).select("name", "c1", "c2", "delta").collect())) == [("x", 2, 5, 3), ("y", 0, 1, 1)]


def test_noise_words_and_spellings_roll_up(spark):
    df = spark.createDataFrame([("Acme", 1), ("ACME", 2), ("Battery", 9), ("pixelo", 3), ("Globex", 1)], "brand string, count long")
    aliases = spark.createDataFrame([("Pixelo", "Globex")], "alias string, canonical string")
    assert sorted(map(tuple, D.alias_rollup(df, aliases).collect())) == [("ACME", 3), ("Globex", 4)]


def test_clusters_skip_records_without_a_signal(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at, "x", "one", []), ("b", at, "x", "", []), ("c", at, "y", None, [1])], "capture_id string, captured_at timestamp, platform string, user_prompt string, sources array<int>")
    assert sorted(map(tuple, D.saved_clusters(df).collect())) == [("2024-01-01", "(no prompt)", 1, "y"), ("2024-01-01", "one", 1, "x")]


@pytest.mark.parametrize(("function", "cases"), [
    (T.timeline_key, {"What  is it?!": "what is it", " a ? ": "a ?", "x.,": "x"}), (T.is_noise_label, {"Acme": False, "ab": True, None: True, "x" * 61: True, "Final Verdict": False, "Top: x": False, "Best phones of 2024": False, "Overall winner": True, "overalls": False, "In 2024 only": True, "approx. 5": True, "—–| :.": True, "a ---- b": True, "a||b c": True}),
    (T.plain_snippet, {"# Head\n- **a** [b](http://c) ![i](j)\n---\n1. `d`": "Head a b d"}), (M.percent_text, {"12.34": "12.3%", None: "–"}), (M.position_text, {"2": "#2.0", None: "–"}),
])
def test_text_forms(spark, function, cases):
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    c = F.col("c").cast("double") if function in (M.percent_text, M.position_text) else F.col("c")
    assert {r[0]: r[1] for r in df.select("c", function(c)).collect()} == cases


def test_links_to_a_text(spark):
    df = spark.createDataFrame([("https://a/x", " it's 5 % "), (None, "x")], "u string, t string")
    assert [r[0] for r in df.select(T.text_fragment(F.col("u"), F.col("t"))).collect()] == ["https://a/x#:~:text=it%27s%205%20%25", None]


def test_json_sink_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], None), ("b\n\"", [], "x")], "k string, v array<int>, w string")
    exports.write_json(df, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("*.json.gz"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_performance_without_an_own_brand(spark):
    schema = "capture_id string, captured_at timestamp, platform string, prompt_id string, brand_mentions array<struct<brand:string,count:bigint,first_index:bigint>>, sources array<struct<url:string,domain:string,outcome:string>>"
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at, "x", "q", [("R", 1, 0)], []), ("b", at, "x", None, [], []), ("c", at + dt.timedelta(1), "x", "q", [], [])], schema)
    got = M.prompt_performance(df, [M.Brand("R")]).orderBy("run").collect()
    assert [(r["capture_id"], r["run"], r["mentioned"], r["position"]) for r in got] == [("c", 1, False, None), ("a", 2, False, None)]


def test_bound_documents_have_contents():
    html = exports.bound_documents([{"user_prompt": "One <b>"}, {"generated_title": "Two", "answer_text": "# Head"}])
    assert html.count("<article") == 2 and "<a href='#c0'>One &lt;b&gt;</a>" in html and "<h2>Head</h2>" in html


def test_audit_log_with_its_preamble(spark):
    from answerscope.plans.tpch import responses
    from answerscope.sources.exports import AUDIT_PREAMBLE, audit_lines

    df = responses(spark, "/root/testdata/sf0.001")
    lines = [r["value"] for r in audit_lines(df).orderBy("line").collect()]
    assert tuple(lines[:3]) == AUDIT_PREAMBLE and lines[3].count(",") == 11 and lines[3].startswith('"#","Date"')
    assert len(lines) == df.count() + 4 and [x.split(",")[0] for x in lines[4:8]] == ['"1"', '"2"', '"3"', '"4"']


def test_best_for_lines_name_a_category():
    from answerscope.functions.analysis import callout, list_category

    assert callout("x\n  **Best for:** Gaming, travel\n") == "Gaming" and callout("Best for: today only") is None and callout("Best for: ---") is None and callout("best for you") is None
    assert list_category("Acme", "1. Acme (Best value)\nBest for: travel") == (1, "Best value") and list_category("Acme", "1. Acme\nBest for: travel.") == (1, "travel")


def test_rows_are_numbered_over_all_ranges(spark):
    from pyspark.sql import functions as F

    from answerscope.operators.dashboards import numbered

    got = numbered(spark.range(1000).repartition(7).withColumn("k", F.col("id") % 10), "n", "k", "id").collect()
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == sorted((i % 10, i) for i in range(1000)) and sorted(r["n"] for r in got) == list(range(1, 1001))


def test_timelines_spread_with_the_input(spark, tmp_path, monkeypatch):
    """The number of tasks over prompts follows the size of the input, so that what one holds does not grow with it."""
    from answerscope import files
    from answerscope.operators import dashboards as D

    path = f"{tmp_path}/r"
    spark.range(1000).selectExpr("cast(id % 300 as string) prompt_key", "id capture_id", "timestamp_seconds(id) captured_at").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(files, "PIECE", 500)
    tasks = D.timelines(df).rdd.getNumPartitions()
    assert tasks > 8 and D.timelines(df).count() == 1000
    monkeypatch.setattr(files, "PIECE", 250)
    assert D.timelines(df).rdd.getNumPartitions() > 1.5 * tasks


def test_matrix_shuffles_the_captures_once(spark):
    """Places, zeros and changes stay on the prompt's key."""
    from answerscope.operators import dashboards as D

    rows = [("p", k, k, [("a", 2)] if k in (2, 4) else [("b", 1), ("b", 2)] if k == 5 else None) for k in range(1, 6)] + [("q", 9, 1, [("a", 7)])]
    df = spark.createDataFrame(rows, "prompt_key string, capture_id long, captured_at long, brand_mentions array<struct<brand:string,count:long>>")
    out = D.matrix_rows(df, D.brand_values(df))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["name"], r["ordinal"]): (r["value"], r["points"], r["delta"]) for r in out.collect()}
    want = {("a", k): (2 if k in (2, 4) else 0, 5, 0) for k in range(1, 6)} | {("b", k): (3 if k == 5 else 0, 5, 3) for k in range(1, 6)}
    assert got == want and out.count() == 10
