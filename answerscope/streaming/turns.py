"""Turns of a run on Structured Streaming: debounce, watchdog, outcomes and estimates, from keyed state and event-time timers.

``InOrder`` keeps the rows of a key in a list state until the watermark has
passed them and then takes them one by one in time order, so that a result does not
depend on how the rows were cut into batches.  Timers wake it: at the time of
the oldest waiting row, and at the deadline of what is open.  A key's state
is what lies within the watermark's delay, a few numbers, and the last ten durations.
The numbers are one value, which is read and written once for all rows that are due.

Timers are event-time timers, so a replay gives what the live run gave.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DEBOUNCE_MS, TIMEOUT_MS = 2500, 90_000
#: Durations of turns that an estimate is the mean of.
RECENT = 10
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Streams started within keep their state as ``transformWithState`` asks for; the session's setting is put back."""
    had = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, had)


class InOrder(StatefulProcessor):
    """Rows ``(us, tie, ...)`` of a key by time.  Subclasses have ``columns`` (a DDL that begins with ``us bigint``), ``numbers`` (a DDL of the key's own state) and the hooks ``row``, ``deadline`` and ``silence``, which find and leave the numbers in ``own`` (None: no state)."""

    columns = "us bigint, tie bigint"
    numbers = "ms bigint"
    own: tuple | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        fields = [c.split() for c in self.columns.split(",")]
        self._names = [name for name, _ in fields]
        # An entry a batch, a list a column: a value for each row would cost a conversion each on its way to the state and back.
        self._waiting = handle.getListState("waiting", ", ".join(f"{name} array<{kind}>" for name, kind in fields))
        self._stored = handle.getValueState("own", self.numbers)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self._names) for r in rows]
        if new:
            self._waiting.appendValue(tuple(map(list, zip(*new))))
            self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        had = self.own = self._stored.get()
        rows = sorted(r for part in self._waiting.get() for r in zip(*part)) if self._waiting.exists() else []
        due = [r for r in rows if r[0] < now]
        for r in due:
            yield from self.silence(key, r[0])
            yield from self.row(key, r)
        yield from self.silence(key, now)
        if due and len(due) < len(rows):
            self._waiting.put([tuple(map(list, zip(*rows[len(due) :])))])
            self._wake(rows[len(due)][0])
        elif due:
            self._waiting.clear()
        if self.own is None and had is not None:
            self._stored.clear()
        elif self.own != had:
            self._stored.update(self.own)
        limit = self.deadline()
        if limit is not None:
            self._wake(limit)

    def _wake(self, us: int) -> None:
        """Called again when no row of this time can come any more."""
        self._handle.registerTimer(us // 1000 + 1)

    def row(self, key, r: tuple) -> Iterator[Row]:
        """The next row in time order."""
        return iter(())

    def deadline(self) -> int | None:
        """The microsecond after which ``silence`` has something to say."""
        return None

    def silence(self, key, now: int) -> Iterator[Row]:
        """Nothing came before ``now``."""
        return iter(())


class Debounce(InOrder):
    """An event counts if it comes ``millis`` or more after the last one that counted."""

    def __init__(self, millis: int = DEBOUNCE_MS):
        self.millis = millis

    def row(self, key, r) -> Iterator[Row]:
        ms = r[0] // 1000
        if self.own is None or ms - self.own[0] >= self.millis:
            self.own = (ms,)
            yield Row(key=key[0], id=r[1], at=ms)


class Watchdog(InOrder):
    """Of each event whether the silence after it went beyond the limit: known when the next one comes, or when the limit has passed."""

    numbers = "us bigint, id bigint"

    def __init__(self, millis: int = TIMEOUT_MS):
        self.us = millis * 1000

    def row(self, key, r) -> Iterator[Row]:
        if self.own is not None:
            yield Row(key=key[0], id=self.own[1], timed_out=False)
        self.own = tuple(r[:2])

    def deadline(self) -> int | None:
        return None if self.own is None else self.own[0] + self.us

    def silence(self, key, now) -> Iterator[Row]:
        if self.own is not None and now > self.own[0] + self.us:
            yield Row(key=key[0], id=self.own[1], timed_out=True)
            self.own = None


OUTCOME = "run_id string, platform string, ordinal bigint, status string, reason string, at_ms bigint, done bigint, failed bigint, total bigint, avg_ms double, eta_ms double"


class Turns(InOrder):
    """The turns of a platform in a run.

    Rows are of a kind: ``start`` (of the run, with its number of prompts), ``capture`` (a completion, which counts if it has a signal and is not within
    the debounce after the last advance) or ``failure`` (with a reason).  A turn without any of them within the timeout has
    failed as well.  Each outcome moves the platform to its next prompt; after the last one nothing counts.
    """

    columns = "us bigint, tie bigint, kind string, signal boolean, total bigint, reason string"
    # The place in the list, what became of the prompts before it, when the turn began, when the last one ended, and the last durations.
    numbers = "ordinal bigint, done bigint, failed bigint, total bigint, began bigint, last bigint, took array<bigint>"

    def __init__(self, debounce: int = DEBOUNCE_MS, timeout: int = TIMEOUT_MS):
        self.debounce, self.timeout = debounce, timeout

    def row(self, key, r) -> Iterator[Row]:
        us, _, kind, signal, total, reason = r
        ms = us // 1000
        if kind == "start":
            if self.own is None:
                self.own = (0, 0, 0, total, ms, None, [])
            return
        if self.own is None:
            return
        ordinal, _, _, total, began, last, took = self.own
        if ordinal >= total or kind == "capture" and (not signal or last is not None and ms - last < self.debounce):
            return
        if kind == "capture":
            self.own = (*self.own[:-1], [*took[1 - RECENT :], ms - began])
        yield self._outcome(key, ms, "done" if kind == "capture" else "failed", reason if kind == "failure" else None)

    def deadline(self) -> int | None:
        if self.own is None:
            return None
        ordinal, _, _, total, began, _, _ = self.own
        return (began + self.timeout) * 1000 + 999 if ordinal < total else None

    def silence(self, key, now) -> Iterator[Row]:
        while (limit := self.deadline()) is not None and now > limit:
            yield self._outcome(key, limit // 1000, "failed", "timeout")

    def _outcome(self, key, ms: int, status: str, reason: str | None) -> Row:
        ordinal, done, failed, total, _, _, took = self.own
        done, failed = done + (status == "done"), failed + (status == "failed")
        self.own = (ordinal + 1, done, failed, total, ms, ms, took)
        mean = sum(took) / len(took) if took else None
        left = total - ordinal - 1
        return Row(run_id=key[0], platform=key[1], ordinal=ordinal, status=status, reason=reason, at_ms=ms, done=done, failed=failed, total=total, avg_ms=mean, eta_ms=None if mean is None else mean * left)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return events.withColumn("_at", at).withColumn("us", F.unix_micros(at)).withWatermark("_at", late)


def debounce(events: DataFrame, key: str, ts: str, tie: str, millis: int = DEBOUNCE_MS, late: str = "1 minute") -> DataFrame:
    """The events of a stream that count, as ``key, id, at`` (milliseconds)."""
    df = _timed(events, ts, late).select(F.col(key).cast("string").alias("key"), F.col(tie).cast("bigint").alias("tie"), "us", "_at")
    return df.groupBy("key").transformWithState(Debounce(millis), "key string, id bigint, at bigint", "append", "eventTime")


def watchdog(events: DataFrame, key: str, ts: str, tie: str, millis: int = TIMEOUT_MS, late: str = "1 minute") -> DataFrame:
    """Of each event of a stream, as ``key, id, timed_out``, whether the silence after it went beyond the limit."""
    df = _timed(events, ts, late).select(F.col(key).cast("string").alias("key"), F.col(tie).cast("bigint").alias("tie"), "us", "_at")
    return df.groupBy("key").transformWithState(Watchdog(millis), "key string, id bigint, timed_out boolean", "append", "eventTime")


def turns(events: DataFrame, debounce: int = DEBOUNCE_MS, timeout: int = TIMEOUT_MS, late: str = "1 minute") -> DataFrame:
    """``events(run_id, platform, at, tie, kind, signal, total, reason)`` as a stream -> a row each time a turn ends (``OUTCOME``), with what is left as of then."""
    df = _timed(events, "at", late).select("run_id", "platform", "_at", "us", F.col("tie").cast("bigint").alias("tie"), "kind", F.coalesce("signal", F.lit(False)).alias("signal"), F.col("total").cast("bigint").alias("total"), "reason")
    return df.groupBy("run_id", "platform").transformWithState(Turns(debounce, timeout), OUTCOME, "append", "eventTime")


def latest(outcomes: DataFrame) -> DataFrame:
    """Where each platform of a run stands: its newest outcome."""
    rest = [c for c in outcomes.columns if c not in ("run_id", "platform")]
    return outcomes.groupBy("run_id", "platform").agg(F.max_by(F.struct(*rest), F.col("ordinal")).alias("x")).select("run_id", "platform", "x.*")


def run_status(outcomes: DataFrame, platforms: DataFrame) -> DataFrame:
    """A row a run: ``total, done, failed, position`` over its platforms, and ``eta_ms`` of the slowest one, which is unknown if one that has prompts left has no estimate.

    ``platforms(run_id, platform, total)`` lists what was started, so that one without an outcome counts.
    """
    at = platforms.join(latest(outcomes).drop("total"), ["run_id", "platform"], "left").na.fill(0, ["done", "failed"])
    left = F.col("total") > F.col("done") + F.col("failed")
    known = F.count_if(left & F.col("eta_ms").isNull()) == 0
    sums = [F.sum(c).alias(c) for c in ("total", "done", "failed")]
    return at.groupBy("run_id").agg(*sums, F.sum(F.col("done") + F.col("failed")).alias("position"), F.when(known, F.coalesce(F.max(F.when(left, F.col("eta_ms"))), F.lit(0.0))).alias("eta_ms"))


def progress(prompts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``prompts(run_id, platform, ordinal, ...)`` with ``status`` and ``reason``: the outcome if there is one, else ``running`` at the place after the last outcome, ``done`` before it and ``pending`` after it."""
    place = outcomes.groupBy("run_id", "platform").agg((F.max("ordinal") + 1).alias("_place"))
    own = outcomes.select("run_id", "platform", "ordinal", F.col("status").alias("_status"), "reason")
    df = prompts.join(place, ["run_id", "platform"], "left").join(own, ["run_id", "platform", "ordinal"], "left")
    at = F.coalesce("_place", F.lit(0))
    status = F.coalesce("_status", F.when(F.col("ordinal") == at, "running").when(F.col("ordinal") < at, "done").otherwise("pending"))
    return df.select(*prompts.columns, status.alias("status"), "reason")
