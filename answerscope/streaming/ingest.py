"""Streaming ingest: lands captures and derives their records batch by batch, and stores what became of the turns of a run.

The state of the turns is in ``turns``; here are what a batch writes, and the batch forms of its rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metrics import NOT_LOCATED  # noqa: F401  re-exported for readers of derived rows
from ..sources.payloads import derive, landing
from .turns import TIMEOUT_MS, state_store, turns



def ingest(captures: DataFrame, upsert_raw: Callable[[DataFrame], None], upsert_derived: Callable[[DataFrame], None], checkpoint: str, max_mb: int = 8, after: Callable[[], object] | None = None, upsert_errors: Callable[[DataFrame], None] | None = None):
    """A started query: raw rows first, then their records, those that can't be read to ``upsert_errors``, then ``after`` (retention); a replayed batch upserts the same keys."""

    def batch(df: DataFrame, _: int) -> None:
        usable, _skipped = landing(df, max_mb)
        upsert_raw(usable)
        derived = derive(usable)
        upsert_derived(derived.where("error is null").drop("error"))
        if upsert_errors:
            upsert_errors(derived.where("error is not null").select("capture_id", "error"))
        if after:
            after()

    return captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track(events: DataFrame, keep: Callable[[DataFrame], None], checkpoint: str, **how):
    """A started query that gives each batch's outcomes of turns to ``keep``, which upserts them: a replayed batch has the same keys."""
    key = F.concat_ws("|", "run_id", "platform", "ordinal")
    with state_store(events.sparkSession):
        out = turns(events, **how).withColumn("id", key)
        return out.writeStream.foreachBatch(lambda df, _: keep(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile(snapshot: Column, completed: Column, prompts: Column, elapsed_ms: Column, timeout: int = TIMEOUT_MS) -> tuple[Column, Column]:
    """Position and status after a restart: the position is the larger of the snapshot and the true count; a turn silent for too long has failed."""
    at = F.greatest(snapshot, F.least(completed, prompts))
    return at, F.when(at >= prompts, "done").when(elapsed_ms > timeout, "failed").otherwise("running")


def silences(events: DataFrame, key: str, ts: str, tie: str, limit_ms: int = TIMEOUT_MS) -> DataFrame:
    """The batch form of the watchdog: of each event that another follows, whether the silence after it went beyond the limit."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("timed_out", gap > limit_ms * 1000).where("timed_out is not null")


def weekly_windows(events: DataFrame, ts: str = "captured_at", late: str = "1 day") -> DataFrame:
    """Extension: Monday weeks as event-time windows with bounded state."""
    w = F.window(F.col(ts), "7 days", startTime="4 days")
    return events.withWatermark(ts, late).groupBy(w, "platform").agg(F.count("*").alias("captures"))
