"""Candidates for names from the structure of texts: cells of markdown tables, bold leads of lines, headings.  Lines are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, js_trim, table_cells
from .metrics import once

#: Longest text that is taken for a name.
LONGEST = 40


def text_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line, text`` of the lines of ``texts(keys, text)``."""
    return texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("line", "text"))


def _placed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``cells``, ``cell`` (the first of them) and ``pipe`` (a line that may be of a table), and ``table`` (the line of the head) where it is a data row.

    A head has two cells or more, and the next line is a rule of as many.  Consecutive lines with a pipe are an island (a line's number less its
    rank among such lines); the first head of an island begins its table, and what follows the rule to the island's end are its rows.
    Lines without a pipe may be left out.  What the windows need of the cells is found before them, so that cells nobody reads are not sorted.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    df = lines.withColumn("pipe", once(F.contains("text", F.lit("|")) & (js_trim(F.col("text")) != ""))).withColumn("cells", once(F.when(F.col("pipe"), table_cells(js_trim(F.col("text"))))))
    df = df.withColumn("_n", F.size("cells")).withColumn("cell", F.get("cells", F.lit(0))).withColumn("_rule", F.coalesce(F.forall("cells", lambda c: c.rlike("^:?-+:?$")), F.lit(False)))
    below = F.lead(F.struct("line", "_n", "_rule")).over(w)
    df = df.withColumn("_below", below).withColumn("_island", F.col("line") - F.count_if("pipe").over(w))
    head = F.col("pipe") & (F.col("_n") >= 2) & (F.col("_below.line") == F.col("line") + 1) & (F.col("_below._n") == F.col("_n")) & F.col("_below._rule")
    first = F.min(F.when(head, F.col("line"))).over(Window.partitionBy(*keys, "_island"))
    return df.withColumn("_first", first).withColumn("table", F.when(F.col("pipe") & (F.col("line") > F.col("_first") + 1), F.col("_first"))).drop("_n", "_rule", "_below", "_island", "_first")


def table_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Data rows of markdown tables: ``keys, line, table`` (the line of its head), ``cells``."""
    return _placed(lines, keys).where("table is not null").select(*keys, "line", "table", "cells")


def clean_candidate(text: Column) -> Column:
    """Without emphasis, leading signs and list numbers; what stands before a dash or pipe, or else after an arrow, or else after a colon; null if empty or too long."""
    dash = r"\s+[—–|]\s+"

    def part(t):
        last = lambda sep: js_trim(F.element_at(F.split(t, sep), -1))
        return F.when(t.rlike(dash), js_trim(F.split(t, dash)[0])).when(F.contains(t, F.lit("→")), last("→")).when(F.contains(t, F.lit(":")), last(":")).otherwise(t)

    plain = js_trim(F.regexp_replace(js_trim(F.regexp_replace(text, "[*_`]", "")), r"^[^A-Za-z0-9_]+", ""))
    return bound(js_trim(F.regexp_replace(bound(plain, part), r"^[0-9]+[.)]\s*", "")), lambda t: F.when(F.length(t).between(1, LONGEST), t))


def candidates(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, line, candidate`` of what may be names in ``texts(keys, text)``: kind ``table`` (the first cell of a row), ``bold`` (at the start of a line, after
    marks of headings and lists) and ``heading`` (from the second level on)."""
    # One pass over the lines that can hold any of them.
    lines = text_lines(texts, keys).where(F.contains("text", F.lit("|")) | F.contains("text", F.lit("**")) | F.startswith("text", F.lit("##")))
    bold = F.when(F.contains("text", F.lit("**")), F.regexp_extract("text", r"^[ \t]*#{0,6}[ \t]*(?:[0-9]+[.)][ \t]*)?[-*•]?[ \t]*\*\*([^*]{2,40})\*\*", 1))
    heading = F.when(F.startswith("text", F.lit("##")), F.regexp_extract("text", r"^#{2,6}[ \t]*([^#*]{2,60})", 1))
    df = _placed(lines.withColumn("bold", once(bold)).withColumn("heading", once(heading)), keys)
    kinds = {"bold": F.col("bold"), "heading": F.col("heading"), "table": F.when(F.col("table").isNotNull(), F.col("cell"))}
    said = df.select(*keys, "line", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("raw")) for k, c in kinds.items()])).alias("x"))
    # Kept where it is computed: the filter would compute it again.
    return said.select(*keys, "x.kind", "line", "x.raw").where("raw <> ''").select(*keys, "kind", "line", once(clean_candidate(F.col("raw"))).alias("candidate")).where("candidate is not null")
