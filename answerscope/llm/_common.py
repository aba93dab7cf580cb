"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII control white space.
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up in a Python worker.

    The bound is only ever lowered, so a plan that runs later never gets larger batches than its operator asked for.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a local session (as in tests); a cluster without one is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder and survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def set_aside(df: DataFrame, names) -> DataFrame:
    """``df`` with columns that are named like a result renamed to ``<name>_in`` (with more underscores while that is taken)."""
    for name in names:
        if name in df.columns:
            free = f"{name}_in"
            while free in df.columns or free in names:
                free += "_"
            df = df.withColumnRenamed(name, free)
    return df


def in_fold(col, modulus: int, remainder: int):
    """Fold of a row: crc32 of the id written as decimal text, modulo ``modulus``.  A null id is in no fold."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``node, component`` (smallest reachable id).

    Alternates large-star and small-star steps, so a long chain needs a
    logarithmic number of rounds; each round is two shuffles of the edges and is
    cut into the shared checkpoint folder.  Nothing but one change counter comes
    to the driver.  Hot nodes only meet in ``min`` aggregates, which combine
    before the shuffle, and in joins that AQE may split.  Components that have
    not settled after ``max_rounds`` are an error, never a partial result.
    """
    cur = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # Every neighbour moves to the smallest node around; (a > b) afterwards.
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Cut, so that the join below shuffles both sides and AQE can split the rows of a hot centre.
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = large.join(low2, F.col("a") == F.col("node"))
        nxt = small.select("b", "m").where("b <> m").toDF("a", "b").union(low2.select(F.col("node"), "m").toDF("a", "b"))
        nxt = cut(nxt.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # A fixed point is a forest of stars: every node but the centres has one smaller neighbour, itself a centre.
        chained = nxt.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a").limit(1)
        centre = nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a").limit(1)
        cur = nxt
        if not chained.union(centre).head(1):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
