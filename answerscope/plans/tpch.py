"""Role mapping: the driver's tables read as assistant responses.

An order is a response (platform: its priority, prompt: its customer); its
lines are sources (supplier: domain, part: URL, return flag: outcome) and brand
mentions (part brand; line number: first index; quantity: count, 0 for lines
that are only shown).  Cited and fetched sources are what the fan-out asked for, and
a response with any of them has searched.  The answer's text names a brand by
the order's number, in the brand's own spelling, in capitals or in lower case.

``store_responses`` writes the nested records once; ``responses`` then reads
them, as queries of the engine read its derived table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import spread, spread_for
from ..operators.metrics import Brand

#: The tracked list of the flagship campaign; the last is in no table.
BRANDS = [Brand("Brand#11", "Supplier#000000001", True), Brand("Brand#22", "Supplier#000000002"), Brand("Brand#3", "Supplier#000000003"), Brand("Brand#4", "Supplier#000000004"), Brand("Brand#99", "Supplier#999999999")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome(flag):
    return F.when(flag == "R", "cited").when(flag == "A", "fetched").otherwise("mentioned")


#: Where the nested records of a folder of tables are stored.
STORED: dict[str, str] = {}


def store_responses(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the nested records to ``path``, by status, and lets ``responses`` read them from there."""
    _build(spark, sf_dir, None).withColumn("_status", F.coalesce("geo.run_id", F.lit(""))).write.mode("overwrite").partitionBy("_status").parquet(path)
    STORED[sf_dir] = path


def responses(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Nested records of all orders, or of those with ``status``."""
    if sf_dir in STORED:
        df = spark.read.parquet(STORED[sf_dir])
        return (df.where(F.col("_status") == status) if status else df).drop("_status")
    return _build(spark, sf_dir, status)


def _build(spark: SparkSession, sf_dir: str, status: str | None) -> DataFrame:
    """One join pass over the lines of the orders asked for, and one grouping by order, on whose key everything stays partitioned.

    Each join has partitions by the input's size; customers join the orders before these get their lines, which are many times larger.
    """
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    if status:
        orders = orders.where(F.col("o_orderstatus") == status)
        # Not a semi join, which the optimizer would push below the partitioning.
        asked_for = orders.select(F.col("o_orderkey").alias("l_orderkey"))
        lines = spread_for(lines, asked_for, "l_orderkey").join(spread_for(asked_for, lines, "l_orderkey").distinct(), "l_orderkey")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = spread_for(lines, parts, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = spread_for(lines, suppliers, "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    count = F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_quantity").cast("bigint"))
    line = F.struct(F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), F.col("s_name").alias("domain"), outcome(F.col("l_returnflag")).alias("outcome"), F.col("p_brand").alias("brand"), count.alias("count"))
    # Lists do not shrink by combining before the shuffle, so the lines are shuffled first and gathered once.
    nested = spread(lines, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    df = spread_for(orders, customers, "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lines_ = F.coalesce(F.col("lines"), F.array().cast(nested.schema["lines"].dataType))
    df = df.withColumn("lines", lines_)
    of = lambda b: F.filter("lines", lambda x: x["brand"] == b)
    mention = lambda b: F.struct(b.alias("brand"), F.aggregate(of(b), F.lit(0).cast("bigint"), lambda a, x: a + x["count"]).alias("count"), F.array_min(F.transform(of(b), lambda x: x["ord"])).cast("bigint").alias("first_index"))
    source = lambda x: F.struct(x["part"].cast("string").alias("url"), x["domain"].alias("domain"), x["outcome"].alias("outcome"))
    asked = lambda o: F.transform(F.filter("lines", lambda x: x["outcome"] == o), lambda x: F.struct(x["domain"].alias("query")))
    profile = F.when(F.col("o_orderstatus") == "F", F.lit("p1"))
    key = F.col("o_orderkey")
    word = F.element_at(F.array(F.lit("Brand"), F.lit("BRAND"), F.lit("brand")), (key % 3 + 1).cast("int"))
    text = F.concat(F.lit("See "), F.col("o_orderpriority"), F.lit(": "), word, F.lit("#"), (key % 25).cast("string"), F.lit(" and others."))
    return df.select(
        key.alias("capture_id"), F.col("o_orderdate").cast("timestamp").alias("captured_at"), F.col("o_orderpriority").alias("platform"), F.col("o_custkey").alias("prompt_id"), F.col("c_name").alias("user_prompt"),
        F.struct(profile.alias("profile_id"), F.col("o_orderstatus").alias("run_id"), F.array("c_mktsegment").alias("tags")).alias("geo"),
        F.transform("lines", source).alias("sources"), F.transform(F.array_distinct(F.transform("lines", lambda x: x["brand"])), mention).alias("brand_mentions"),
        F.struct(asked("cited").alias("search"), asked("fetched").alias("shopping"), F.array().cast("array<struct<query:string>>").alias("image")).alias("fanout"),
        F.exists("lines", lambda x: x["outcome"] != "mentioned").alias("searched"), text.alias("answer_text"), F.length(text).cast("bigint").alias("answer_chars"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prompt_id"), F.col("c_name").alias("prompt_text"))
