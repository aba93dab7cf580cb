"""Audit of how filters interact: what each filter removes under every order of application, by part.

``LETTERS`` names five filters.  A document's failures are five bits, so how it
leaves under an order is a lookup: ``first_failures`` holds, for each of the 32
sets of failures and each of the 120 orders, the step of the first failing
filter (5: none fails).  ``mapInArrow`` indexes that table with the failures of
a batch and ``np.bincount`` counts (part, order, step), for all documents, the
good and the toxic ones.  Each task sends one array a part, and Spark sums them.

Everything else follows from those sums: a filter that comes first removes all
that fail it, one that comes last removes what fails it alone.

The filters (words are runs of anything but space and ASCII control white space):

- A: fewer than 200 words
- B: fewer distinct words than half the words
- C: over 2 % of the code points are A-Z
- D: one of ``#$%&*|`` occurs
- E: the same text as a row of a smaller id, of the whole table

Equal texts are found by their SHA-256 digests, whose least id combines before
the shuffle; texts themselves are not shuffled.  A task holds counts of at most
``PARTS`` parts and sends them on beyond that, so any number of parts is exact.

Defined cases: a null text is empty (it fails A); a null part is the empty
string; a row without an id is never a copy and no row is a copy of it, and it
has no label; rows that repeat an id are judged each, and only smaller ids make
copies; of several labels of an id, 1 wins; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, small_batches

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
#: Parts of which a task holds counts at a time (about 17 KB each).
PARTS = 1024
#: Bit of the copies in a set of failures; those before it are found in the text alone.
COPY = 1 << LETTERS.index("E")

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL = re.compile(rb"[#$%&*|]")
#: Columns that the counting task sends, each an array of len(ORDERS) * (len(LETTERS) + 1) numbers.
_KINDS = ("n", "good", "toxic")


def first_failures() -> np.ndarray:
    """Step (from 0) at which each set of failures leaves under each order; 5 where nothing fails."""
    places = np.array([[LETTERS.index(x) for x in order] for order in ORDERS])
    fails = (np.arange(1 << len(LETTERS))[:, None, None] >> places) & 1
    return np.where(fails.any(2), fails.argmax(2), len(LETTERS)).astype(np.int64)


def failures(text: str) -> int:
    """Bits of A to D; the lowest bit is A."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(_SYMBOL.search(raw)) << 3


def judge(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, fails`` (bits of A to E) of every row.  Shuffles digests, not texts."""
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            fails = pa.array([failures(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fails, digest], names=["doc_id", "part", "fails", "digest"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(part), F.lit("")).alias("part"))
    facts = cut(read.mapInArrow(run, "doc_id long, part string, fails int, digest binary"))
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return facts.join(first, "digest", "left").select("doc_id", "part", (F.col("fails") + F.when(copy, COPY).otherwise(0)).alias("fails"))


def _counted(judged: DataFrame) -> DataFrame:
    """``part`` and an array each of ``_KINDS``, by task, of ``judged(part, fails, good, toxic)``."""
    steps = len(LETTERS) + 1
    width = len(ORDERS) * steps

    def run(batches):
        # Of a set of failures, its place in the counts of a part under every order.
        table = first_failures() + steps * np.arange(len(ORDERS))
        parts: dict[str, int] = {}
        sums = np.zeros((len(_KINDS), 0), np.int64)

        def sent():
            rows = sums.reshape(len(_KINDS), len(parts), width)
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), *(pa.array(list(x), pa.list_(pa.int64())) for x in rows)], names=["part", *_KINDS])

        for b in batches:
            for k in range(0, b.num_rows, PARTS):
                rows = b.slice(k, PARTS)
                names = rows.column(0).to_pylist()
                if len(parts) + len(set(names) - parts.keys()) > PARTS:
                    yield from sent()
                    parts, sums = {}, np.zeros((len(_KINDS), 0), np.int64)
                part = np.array([parts.setdefault(x, len(parts)) for x in names], np.int64)
                at = part[:, None] * width + table[rows.column(1).to_numpy()]
                chosen = [np.ones(len(names), bool), *(rows.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))]
                new = np.stack([np.bincount(at[c].ravel(), minlength=len(parts) * width) for c in chosen])
                new[:, : sums.shape[1]] += sums
                sums = new
        if parts:
            yield from sent()

    return judged.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, " + ", ".join(f"{k} array<long>" for k in _KINDS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row a part, order and step: ``part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``kept`` counts what is left after the step, ``redundant`` what fails its filter but left before, ``unique_fails``
    what fails its filter alone, and ``shapley`` what its filter removes, summed over all orders.
    """
    of = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(of("quality"), of("toxic"))
    marked = judge(docs, part).join(known, "doc_id", "left")
    counted = _counted(marked.select("part", "fails", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
    one = counted.select("part", F.posexplode(F.arrays_zip(*_KINDS)).alias("at", "x"))
    sums = one.groupBy("part", "at").agg(*[F.sum(f"x.{k}").alias(k) for k in _KINDS])
    steps = len(LETTERS) + 1
    order = F.array(*map(F.lit, ORDERS))[(F.col("at") / steps).cast("int")]
    step = (F.col("at") % steps + 1).cast("int")
    rows = sums.select("part", order.alias("filter_order"), step.alias("step"), *_KINDS).withColumn("filter", F.expr("substr(filter_order, step, 1)"))
    # At most 6 and 120 rows share a key.
    later = Window.partitionBy("part", "filter_order").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("part", "filter")
    rows = rows.withColumn("kept", F.sum("n").over(later)).where(f"step < {steps}")
    at = lambda k: F.max(F.when(F.col("step") == k, F.col("n"))).over(same)
    return rows.select(
        "part", "filter_order", "step", "filter", "kept", F.col("n").alias("removed"), (at(1) - F.col("n")).alias("redundant"), at(len(LETTERS)).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(same).alias("shapley"),
    )
