"""Joins of points in time with spans, as equi-joins on keys and time bins.

A span is cut into the bins that it touches, at the level whose bins are at most
``FACTOR`` times shorter than the span, so it has ``FACTOR`` + 2 rows at most whatever its
length.  A point falls into one bin of each level that has spans.  What meets
in a bin is tested exactly.  A hot key is spread over its bins, and one bin
that is still large is an ordinary skewed join partition, which AQE splits.

``last_span`` asks for one span a point only, that which began last.  It pairs no
point with every span around it, so its work grows with the rows, however many
spans are open at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the finest bins in microseconds, how many make one of the next level, and the number of levels (the coarsest bin: 255 years).
FINEST, FACTOR, LEVELS = 60_000_000, 8, 10
#: The level of spans without an end, which has one bin.
OPEN = -1


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _width(level: int) -> int:
    return FINEST * FACTOR**level


def _level(length: Column) -> Column:
    out = F.when(length.isNull(), OPEN)
    for k in range(LEVELS - 1):
        out = out.when(length <= _width(k) * FACTOR, k)
    return out.otherwise(LEVELS - 1)


def _bin(at: Column, level: Column) -> Column:
    width = F.element_at(F.array(*[F.lit(_width(k)).cast("long") for k in range(LEVELS)]), F.greatest(level, F.lit(0)) + 1)
    return F.when(level == OPEN, 0).otherwise(F.floor(at / width)).cast("long")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, since: str, until: str) -> DataFrame:
    """The rows of ``points`` with each row of ``spans`` (as a struct ``span``) of equal keys where since <= at < until; a null ``until`` never ends.

    A null key or time matches nothing, and neither does a span that ends where it begins or before.  ``points`` may not
    have a column ``span``.
    """
    s = spans.select(*keys, _micros(since).alias("_since"), _micros(until).alias("_until"), F.struct(*spans.columns).alias("span"))
    s = s.where("_since is not null and (_until is null or _until > _since)").withColumn("_level", _level(F.col("_until") - F.col("_since")))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # eleven at most
    last = F.when(F.col("_level") == OPEN, F.lit(0)).otherwise(_bin(F.col("_until") - 1, F.col("_level")))
    s = s.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_since"), F.col("_level")), last)))
    p = points.withColumn("_at", _micros(at))
    bins = F.array(*[F.struct(F.lit(k).alias("_level"), _bin(F.col("_at"), F.lit(k)).alias("_bin")) for k in levels]) if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    p = p.where("_at is not null").withColumn("_b", F.explode(bins)).select(*points.columns, "_at", "_b.*")
    both = p.join(s, [*keys, "_level", "_bin"]).where("_at >= _since and (_until is null or _at < _until)")
    return both.select(*points.columns, "span")


#: ``last_span``: a level's bins are 2 ** ``SHIFT`` times as long as those of the level before, which begin with one microsecond.
SHIFT, STEPS = 6, 10


def last_span(points: DataFrame, spans: DataFrame, id_: str, keys: list[str], at: str, since: str, until: str, order: list[str]) -> DataFrame:
    """``id_`` of each point (one row an id) that lies in a span, with ``last``: the one that began last, of several the greatest by ``order``.  Spans are as in ``interval_join``.

    A span is cut at the coarsest level at which it begins and ends in different bins, into 2 ** ``SHIFT`` pieces at most: those that go on to the end of
    their bin, and the last one, which covers a bin's beginning.  What a point looks for in its bin is the greatest of the first kind that
    begin up to it and of the second kind that end after it: two running maxima over the bin in order of time.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    p = points.select(F.col(id_).alias("_id"), *keys, _micros(at).alias("_at")).where(known & F.col("_at").isNotNull())
    beyond = F.lit(p.agg(F.max("_at")).head()[0]).cast("long") + 1  # of what goes on beyond the last point, all ends are the same
    best = F.struct(_micros(since).alias("_us"), F.struct(*order).alias("o"), F.struct(*[c for c in spans.columns if c not in order]).alias("r"))
    s = spans.where(known).select(*keys, _micros(since).alias("_since"), F.least(F.coalesce(_micros(until), beyond), beyond).alias("_until"), best.alias("best")).where("_until > _since")
    level = F.lit(0)
    for k in range(1, STEPS):
        level = F.when(F.shiftright("_since", SHIFT * k) != F.shiftright(F.col("_until") - 1, SHIFT * k), k).otherwise(level)
    s = s.withColumn("_level", level).withColumn("_a", F.expr(f"shiftright(_since, {SHIFT} * _level)")).withColumn("_z", F.expr(f"shiftright(_until - 1, {SHIFT} * _level)"))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # ten at most
    pieces = s.withColumn("_bin", F.explode(F.sequence("_a", "_z")))
    ends = (F.col("_bin") == F.col("_z")) & (F.col("_a") < F.col("_z"))
    begin = F.greatest("_since", F.expr(f"shiftleft(_bin, {SHIFT} * _level)"))
    none = F.lit(None).cast(points.schema[id_].dataType).alias("_id")
    pieces = pieces.select(none, *keys, "_level", "_bin", F.when(ends, F.col("_until")).otherwise(begin).alias("_t"), F.when(ends, 2).otherwise(0).alias("_kind"), "best")
    bins = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright("_at", SHIFT * k).alias("_bin")) for k in levels]) if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    p = p.withColumn("_b", F.explode(bins)).select("_id", *keys, "_b._level", "_b._bin", F.col("_at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(pieces.schema["best"].dataType).alias("best"))
    # At one time: what begins, points, what ends.
    w = Window.partitionBy(*keys, "_level", "_bin")
    w = [w.orderBy(t, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow) for t in ("_t", F.desc("_t"))]
    one = F.greatest(*[F.max(F.when(F.col("_kind") == k, F.col("best"))).over(x) for k, x in zip((0, 2), w, strict=True)])
    df = p.unionByName(pieces).withColumn("best", one).where("_kind = 1 and best is not null").groupBy("_id").agg(F.max("best").alias("best"))
    return df.select(F.col("_id").alias(id_), F.struct(*[F.col(f"best.{'o' if c in order else 'r'}.{c}") for c in spans.columns]).alias("last"))
