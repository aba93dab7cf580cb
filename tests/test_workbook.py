import os
import zipfile

import pytest
from pyspark.sql import functions as F

from answerscope.sources import exports, workbook

CELLS = ["plain", "", None, "=1+1", "<a> & \"b\"", "é 日本 😀", " two  spaces ", "line\nbreak\rand\ttab", "\x01control", "007"]


def shown(cell):
    """A cell as it comes back."""
    t = (cell or "").replace("\x01", "")
    return "'" + t if t[:1] in ("=", "\t", "\r") else t


def test_written_and_read_back(spark, tmp_path):
    a = spark.createDataFrame(list(enumerate(CELLS)), "k int, c string").repartition(3)
    b = spark.createDataFrame([([1, 2], {"x": None})], "l array<int>, m map<string,string>")
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook({"Zed & <Co>": a, "Empty": a.where("false"), "B": b}, path)
    rows = workbook.read_workbook(spark, path).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["row"]):
        by.setdefault(r["sheet"], []).append(r["cells"])
    assert by["Zed & <Co>"][0] == ["k", "c"] and sorted(by["Zed & <Co>"][1:]) == sorted([str(k), shown(c)] for k, c in enumerate(CELLS))
    assert by["Empty"] == [["k", "c"]] and by["B"] == [["l", "m"], ["[1,2]", '{"x":null}']]
    with zipfile.ZipFile(path) as z:
        assert [s for s, _ in workbook.sheets_of(z)] == ["Zed & <Co>", "Empty", "B"] and z.testzip() is None
    assert os.listdir(tmp_path) == ["book.xlsx"]
    assert workbook.read_workbook(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_order_of_rows_is_kept(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbook.write_workbook({"S": spark.range(0, 1000, 1, 7)}, path)
    assert [r["cells"][0] for r in workbook.read_workbook(spark, path).orderBy("row").collect()] == ["id", *map(str, range(1000))]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="no"):
        workbook.write_workbook({"S": bad}, path)
    assert os.listdir(tmp_path) == []


def test_a_full_sheet_goes_on_in_another(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 5)
    w = workbook.Writer(str(tmp_path / "book.xlsx"), ["B", "A"], True)
    rows = lambda sheet, *at: [{"sheet": sheet, "row": k, "cells": [f"{sheet}{k}"]} for k in at]
    w.commit([w.write(iter(rows("A", 0, 1, 2))), None, w.write(iter([*rows("B", 9), *rows("A", 3, 4, 5)])), w.write(iter([]))])
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        got = {name: [r[0] for r in workbook.rows_of(z, entry)] for name, entry in workbook.sheets_of(z)}
    assert list(got) == ["B", "A", "A (2)"] and got == {"B": ["B9"], "A": ["A0", "A1", "A2"], "A (2)": ["A3", "A4", "A5"]}
    with pytest.raises(ValueError, match="more than"):
        w.commit([w.write(iter(rows("A", *range(6))))])
    keep = workbook.Writer(str(tmp_path / "book.xlsx"), [], False)
    with pytest.raises(ValueError, match="exists"):
        keep.commit([keep.write(iter(rows("A", 1)))])


def test_records_as_a_workbook(spark, tmp_path):
    from answerscope.plans.tpch import responses

    path = str(tmp_path / "records.xlsx")
    names = exports.write_workbook(responses(spark, "/root/testdata/sf0.001", "F").drop("geo"), path)
    per = {r["sheet"]: r["n"] for r in workbook.read_workbook(spark, path).groupBy("sheet").agg(F.count("*").alias("n")).collect()}
    assert set(per) == set(names) and per["Summary"] == 2 and per["Audit Log"] > 100


def test_a_task_of_many_rows_fills_several_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 5)
    monkeypatch.setattr(workbook, "FRAGMENT_ROWS", 2)
    w = workbook.Writer(str(tmp_path / "book.xlsx"), ["A"], True)
    rows = lambda sheet, n: [{"sheet": sheet, "row": k, "cells": [f"{k}"]} for k in range(n)]
    w.commit([w.write(iter([*rows("A", 12), *rows("Own", 1)]))])
    df = workbook.read_workbook(spark, str(tmp_path / "book.xlsx"))
    assert {r["sheet"]: r["count"] for r in df.groupBy("sheet").count().collect()} == {"A": 4, "A (2)": 4, "A (3)": 4, "Own": 1}
    got = {r["sheet"]: r["count"] for r in workbook.continued(df, ["A", "Own"]).groupBy("sheet").count().collect()}
    assert got == {"A": 12, "Own": 1}


def test_continued_sheets_are_told_from_others(spark):
    names = ["A", "A (2)", "A (3)", "B (2)", "A (x)", "A (2) (2)"]
    df = spark.createDataFrame([(n,) for n in names], "sheet string")
    assert [r["sheet"] for r in workbook.continued(df, ["A", "A (2)"]).collect()] == ["A", "A (2)", "A", "B (2)", "A (x)", "A (2)"]
