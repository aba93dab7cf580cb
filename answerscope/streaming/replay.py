"""Replays a table as a stream: lands it in slices of time, runs a streaming transformation to its end, returns what came out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import scratch
from .turns import state_store


def replay(events: DataFrame, ts: str, make: Callable[[DataFrame], DataFrame], close=None, slices: int = 2) -> DataFrame:
    """The rows of ``make(stream)``.

    ``events`` arrive in ``slices`` of time: each is written to the shared folder (by as many tasks as it has) and the stream goes on from its checkpoint
    to the end of what is there.  ``close`` (a timestamp) is the time of one last row whose other columns are null: it moves the watermark on.
    """
    spark = events.sparkSession
    folder = f"{scratch(spark)}/replay-{uuid.uuid4().hex}"
    at = F.col(ts).cast("timestamp")
    low, high = events.agg(F.min(at.cast("double")), F.max(at.cast("double"))).head()
    width = max(((high or 0.0) - (low or 0.0)) / slices, 1e-6)
    number = F.least(F.floor((at.cast("double") - (low or 0.0)) / width), F.lit(slices - 1))
    arrivals = [events.where((number == k) | number.isNull() if k == 0 else number == k) for k in range(slices)]
    if close is not None:
        kinds = dict(events.dtypes)
        arrivals.append(spark.range(1).select(*[(F.lit(close) if c == ts else F.lit(None)).cast(kinds[c]).alias(c) for c in events.columns]))
    # A stream keeps its number of state partitions for good: two a core, where the session has more.
    parts = "spark.sql.shuffle.partitions"
    had = spark.conf.get(parts)
    for arrival in arrivals:
        arrival.write.mode("append").parquet(f"{folder}/in")
        spark.conf.set(parts, str(min(int(had), max(8, 2 * spark.sparkContext.defaultParallelism))))
        try:
            with state_store(spark):
                out = make(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
                query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        finally:
            spark.conf.set(parts, had)
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
