import datetime as dt
import random

from answerscope.api import PROMPTS, Engine
from answerscope.operators.intervals import FINEST, LEVELS, interval_join
from answerscope.schema import RAW

EPOCH = dt.datetime(1970, 1, 1)
POINTS, SPANS = "id int, k string, at timestamp", "n int, k string, since timestamp, until timestamp"


def joined(spark, points, spans):
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)
    return sorted((r["id"], r["span"]["n"]) for r in interval_join(p, s, ["k"], "at", "since", "until").collect())


def brute(points, spans):
    return sorted((i, n) for i, k, at in points for n, q, a, z in spans if k is not None and k == q and at is not None and a is not None and a <= at and (z is None or at < z))


def test_interval_join_equals_comparing_all(spark):
    rng = random.Random(4)
    at = lambda: EPOCH + dt.timedelta(seconds=rng.choice([-1, 1]) * rng.choice([10.5, 3600, 86_400 * 400, 86_400 * 20_000]) * rng.random())
    spans = []
    for n in range(300):
        since = at()
        length = dt.timedelta(microseconds=rng.choice([-5, 0, 1, FINEST, FINEST * 8, FINEST * 8 + 1, FINEST * 8**5]) + rng.choice([0, 1, 10**9]))
        spans.append((n, rng.choice("abc"), since, rng.choice([since + length, since + length, None])))
    spans += [(900, None, EPOCH, None), (901, "a", None, None), (902, "b", EPOCH - dt.timedelta(days=25_000), EPOCH + dt.timedelta(days=25_000))]
    edges = [t + dt.timedelta(microseconds=d) for _, _, a, z in spans for t in (a, z) if t for d in (-1, 0)]
    points = [(i, rng.choice("abcd"), rng.choice([at(), rng.choice(edges)])) for i in range(500)] + [(900, None, EPOCH), (901, "a", None)]
    assert FINEST * 8 ** (LEVELS - 1) > 10**6 * 86_400 * 365 * 250
    got = joined(spark, points, spans)
    assert got == brute(points, spans) and len(got) > 500


def test_no_spans_and_no_points(spark):
    assert joined(spark, [(1, "a", EPOCH)], []) == [] and joined(spark, [], [(1, "a", EPOCH, None)]) == []


def test_a_span_has_few_rows_at_any_length(spark):
    from pyspark.sql import functions as F

    from answerscope.operators import intervals

    lengths = [10**k for k in range(0, 16)]
    df = spark.createDataFrame([(x,) for x in lengths], "x bigint").withColumn("level", intervals._level(F.col("x")))
    n = df.select((intervals._bin(F.col("x") - 1 + 59_999_999, F.col("level")) - intervals._bin(F.lit(59_999_999), F.col("level")) + 1).alias("n")).agg(F.max("n")).head()[0]
    assert n <= intervals.FACTOR + 2


def test_captures_are_stamped_from_the_position_of_the_run(spark, tmp_path):
    from .test_payloads import sample

    e = Engine(spark, str(tmp_path))
    raw, body = sample()
    start = dt.datetime(2024, 1, 1)
    ms = lambda s: int((start - EPOCH).total_seconds() + s) * 1000
    e.handle("profile-save", id="p1", name="P", brand={"name": "Globex"}, engines=["chatgpt"])
    e.handle("prompt-save", rows=spark.createDataFrame([("q1", "p1", "one", ["a"], True, 1), ("q2", "p1", "two", [], True, 2)], PROMPTS))
    run = e.handle("run-start", profile_id="p1", now_ms=ms(0))["result"]["id"]
    for ordinal, at in ((0, 10), (1, 60), (2, 120)):
        assert e.handle("run-position", run_id=run, platform="chatgpt", ordinal=ordinal, now_ms=ms(at))["ok"]
    assert not e.handle("run-position", run_id="none", platform="chatgpt", ordinal=0, now_ms=0)["ok"]
    own = ("p9", "r9", "q9", [])
    rows = [(k, None, "https://chatgpt.com/backend-api/conversation", body, None, None, start + dt.timedelta(seconds=s), raw, geo, 1) for k, s, geo in (("before", 5, None), ("first", 10, None), ("second", 119, None), ("after", 120, None), ("own", 30, own))]
    assert e.handle("raw-conversation", rows=spark.createDataFrame(rows, RAW))["ok"]
    for table in (e.raw, e.derived):
        got = {r["capture_id"]: r["geo"] and tuple(r["geo"]) for r in table.read().collect()}
        assert got == {"before": None, "first": ("p1", run, "q1", ["a"]), "second": ("p1", run, "q2", []), "after": None, "own": own}
    assert [r["capture_id"] for r in e.handle("get-record", key="first")["result"].collect()] == ["first"]
    again = e.handle("run-position", run_id=run, platform="chatgpt", ordinal=1, now_ms=ms(200))
    assert again["ok"] and e.handle("run-sync", run_id=run, captured=2, failed=0, status="done", now_ms=ms(300))["ok"]
    assert {r["until"] for r in e.positions.read().where("since >= '2024-01-01 00:03:00'").collect()} == {start + dt.timedelta(seconds=300)}
    assert e.handle("clear-all")["ok"] and e.positions.stats() == 0


def test_the_last_span_of_many_open_ones(spark):
    """As comparing all; a point meets a fixed number of rows, not every span around it."""
    from pyspark.sql import functions as F

    from answerscope.operators.intervals import last_span

    rng = random.Random(5)
    at = lambda: EPOCH + dt.timedelta(microseconds=rng.choice([-1, 1]) * rng.choice([30, 10**4, 10**9, 10**12, 10**15]) * rng.randrange(100) // 7)
    spans = []
    for n in range(500):
        since = at()
        spans.append((n, rng.choice("abc"), since, rng.choice([None] + 9 * [since + dt.timedelta(microseconds=rng.choice([-5, 0, 1, 2, 63, 64, 65, 4096, 10**7, 10**10, 10**13, 10**16]))])))
    spans += [(900, None, EPOCH, None), (901, "a", None, None), (902, "b", spans[0][2], None), (903, "b", spans[0][2], None)]
    edges = [t + dt.timedelta(microseconds=d) for _, _, a, z in spans for t in (a, z) if t for d in (-1, 0)]
    points = [(i, rng.choice("abcd"), rng.choice([at(), rng.choice(edges)])) for i in range(700)] + [(900, None, EPOCH), (901, "a", None)]
    want = {}
    begins = {n: a for n, _, a, _ in spans}
    for i, n in brute(points, spans):
        want[i] = max(want.get(i, (EPOCH.min, -1)), (begins[n], n))
    p, s = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS).where("k is not null")
    got = {r["id"]: (r["last"]["since"], r["last"]["n"]) for r in last_span(p, s, "id", ["k"], "at", "since", "until", ["n"]).collect()}
    assert got == want and len(got) > 300
    assert last_span(p, s.where("false"), "id", ["k"], "at", "since", "until", ["n"]).count() == last_span(p.where("false"), s, "id", ["k"], "at", "since", "until", ["n"]).count() == 0


def test_stamps_pair_no_capture_with_every_open_run(spark, tmp_path):
    """A thousand runs that are all open: the plan has no join of captures with spans."""
    from pyspark.sql import functions as F

    from answerscope import store

    ids = spark.range(1000)
    at = F.timestamp_micros(F.col("id"))
    captures = ids.select(F.col("id").alias("capture_id"), F.lit("x").alias("platform"), at.alias("captured_at"))
    positions = ids.select(F.lit("x").alias("platform"), F.col("id").cast("string").alias("run_id"), F.lit("p").alias("profile_id"), F.lit(0).alias("ordinal"), at.alias("since"), F.lit(None).cast("timestamp").alias("until"))
    prompts = ids.select(F.col("id").cast("string").alias("run_id"), F.lit(0).alias("ordinal"), F.lit("q").alias("prompt_id"), F.array(F.lit("t")).alias("tags"))
    df = store.stamp(captures, positions, prompts)
    assert df.where("geo.run_id = cast(capture_id as string) and geo.prompt_id = 'q'").count() == 1000
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "_level" in x]
    assert not joins
