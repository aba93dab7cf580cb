"""The cover of a text by spans: every character belongs to exactly one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``spans(keys, start, end, ...)``, in order of their starts, those that begin where the last kept one ended or later.

    A running maximum of the ends cuts the spans of a text into islands that touch nobody else; only inside an island of several
    spans is the order followed one by one.
    """
    rest = [c for c in spans.columns if c not in (*keys, "start", "end")]
    w = Window.partitionBy(*keys).orderBy("start", "end", *rest)
    df = spans.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)).over(w))
    one = F.struct("start", "end", *rest)
    df = df.groupBy(*keys, "_island").agg(F.array_sort(F.collect_list(one)).alias("s"))
    kind = df.schema["s"].dataType.simpleString()
    begin = F.array().cast(kind)
    chain = F.aggregate("s", begin, lambda a, x: F.when((F.size(a) == 0) | (x["start"] >= F.element_at(a, -1)["end"]), F.concat(a, F.array(x))).otherwise(a))
    return df.select(*keys, F.explode(F.when(F.size("s") > 1, chain).otherwise(F.col("s"))).alias("x")).select(*keys, "x.*")


def cover(texts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Segments ``keys, start, end, type, value, ...`` of ``texts(keys, text)``: the kept spans, and segments of type ``text`` for what lies between, before and after them.

    Places are 0-based, in characters.  A text without spans is one segment; an empty or null one has none.
    """
    w = Window.partitionBy(*keys).orderBy("start")
    rest = [c for c in spans.columns if c not in (*keys, "start", "end", "type")]
    kept = kept_spans(spans, keys).withColumn("_before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    own = F.struct("start", "end", "type", *rest)
    gap = F.struct(F.col("_before").alias("start"), F.col("start").alias("end"), F.lit("text").alias("type"), *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in rest])
    parts = kept.select(*keys, "end", F.explode(F.when(F.col("start") > F.col("_before"), F.array(gap, own)).otherwise(F.array(own))).alias("x")).select(*keys, "x.*")
    last = kept.groupBy(*keys).agg(F.max("end").alias("start"))
    whole = texts.select(*keys, F.length("text").alias("end"))
    tail = whole.join(last, keys, "left").select(*keys, F.coalesce("start", F.lit(0)).alias("start"), "end", F.lit("text").alias("type")).where("start < end")
    both = parts.unionByName(tail, allowMissingColumns=True).join(texts.select(*keys, "text"), keys)
    return both.select(*keys, "start", "end", "type", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), *rest)
