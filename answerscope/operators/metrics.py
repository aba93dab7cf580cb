"""Campaign metrics over tracked responses.

A response is a nested record.  Presence of every tracked brand is computed
inside the record's own row (the tracked list is short and part of the plan),
ranks included, so the only shuffle is the small final aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import day_key, domain_matches, first_index, norm_name, week_key

#: A first index that stands for "shown, but not locatable in the text".
NOT_LOCATED = (1 << 53) - 1
#: Engines, and which of them have an adapter.
ENGINES = {"chatgpt": True, "gemini": True, "perplexity": False, "claude": False, "grok": False}


@dataclass(frozen=True)
class Brand:
    name: str
    domain: str = ""
    is_own: bool = False


def is_tracked() -> Column:
    return F.coalesce(F.col("geo.profile_id") != "", F.lit(False))


def partition_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracked, ad hoc): no metric sees the second, no ad-hoc view the first."""
    return records.where(is_tracked()), records.where(~is_tracked())


def select_tracked(records: DataFrame, profile_id=None, run_id=None, engines=(), tags=(), since=None, until=None) -> DataFrame:
    """Tracked responses within a scope; bounds are inclusive, empty arguments don't filter."""
    df = records.where(is_tracked())
    if profile_id:
        df = df.where(F.col("geo.profile_id") == profile_id)
    if run_id:
        df = df.where(F.col("geo.run_id") == run_id)
    if engines:
        df = df.where(F.col("platform").isin(*engines))
    if since:
        df = df.where(F.col("captured_at") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.where(F.col("captured_at") <= F.lit(until).cast("timestamp"))
    if tags:
        df = df.where(F.arrays_overlap(F.col("geo.tags"), F.array(*map(F.lit, tags))))
    return df


def has_signal(records: DataFrame) -> Column:
    """Anything worth showing: a prompt, fan-out, sources, products, places or an answer, as far as the records have such columns."""
    have = set(records.columns)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    out = F.lit(False)
    if "user_prompt" in have:
        out = out | (F.coalesce(F.length("user_prompt"), F.lit(0)) > 0)
    if "fanout" in have:
        out = out | size("fanout.search") | size("fanout.shopping") | size("fanout.image")
    for c in ("sources", "products", "places"):
        if c in have:
            out = out | size(c)
    return out | (F.coalesce("answer_chars", F.lit(0)) > 0) if "answer_chars" in have else out


def once(col: Column) -> Column:
    """``col``, kept where it is computed: the optimizer would otherwise copy it into lambdas, per element, or below filters."""
    return F.when(F.spark_partition_id() >= 0, col)


def presence(records: DataFrame, brands: list[Brand]) -> DataFrame:
    """``records`` with ``brands``: an array of one struct a tracked brand, in list order, with its rank in the response."""
    has_text = "answer_text" in records.columns

    def one(k: int, b: Brand) -> Column:
        # The first mention of that name; position 0 (no such name) gets index -1, which is null.
        hit = F.get("brand_mentions", (F.array_position("_names", norm_name(F.lit(b.name))) - 1).cast("int"))
        given = F.when(hit["first_index"] < NOT_LOCATED, hit["first_index"])
        at = F.coalesce(given, first_index(F.col("answer_text"), b.name)) if has_text else given
        own = lambda s: domain_matches(s["domain"], F.lit(b.domain))
        return F.struct(
            F.lit(k).alias("brand_ord"), F.lit(b.name).alias("name"), F.lit(b.is_own).alias("is_own"),
            at.alias("idx"), F.coalesce(hit["count"], F.lit(0)).alias("mentions"), (hit.isNotNull() | at.isNotNull()).alias("present"),
            F.coalesce(F.exists("sources", lambda s: own(s) & (s["outcome"] == "cited")), F.lit(False)).alias("cited"), F.coalesce(F.exists("sources", own), F.lit(False)).alias("any_source"),
        )

    df = records.withColumn("_names", once(F.coalesce(F.transform("brand_mentions", lambda m: norm_name(m["brand"])), F.array().cast("array<string>"))))
    df = df.withColumn("brands", once(F.array(*[one(k, b) for k, b in enumerate(brands)])))
    df = df.withColumn("_order", once(F.transform(F.array_sort(F.transform(F.filter("brands", lambda b: b["idx"].isNotNull()), lambda b: F.struct(b["idx"].alias("i"), b["brand_ord"].alias("o")))), lambda x: x["o"])))
    rank = lambda b: F.when(b["idx"].isNotNull(), F.array_position("_order", b["brand_ord"]))
    return df.withColumn("brands", F.transform("brands", lambda b: b.withField("rank", rank(b)))).drop("_order", "_names")


def brand_metrics(records: DataFrame, brands: list[Brand], by: dict[str, Column] | None = None) -> DataFrame:
    """Per brand (and bucket): responses present, visibility, share of voice, average position, citations, source visibility.

    Brands that never appear have a row of zeros; the average position is null where no response ranks the brand.
    """
    keys = list(by or {})
    df = presence(records, brands)
    df = df.select(*[c.alias(k) for k, c in (by or {}).items()], F.explode("brands").alias("b")).select(*keys, "b.*")
    out = df.groupBy(*keys, "brand_ord", "name", "is_own").agg(
        F.count("*").alias("total"), F.count_if("present").alias("responses_present"), F.sum("mentions").alias("mentions"), F.sum("rank").alias("_ranks"), F.count("rank").alias("_ranked"),
        F.count_if("cited").alias("citations"), F.count_if("any_source").alias("source_responses"),
    )
    if not keys:
        # With no response at all there is still a row a brand.
        known = records.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("brand_ord"), F.lit(b.name).alias("name"), F.lit(b.is_own).alias("is_own")) for k, b in enumerate(brands)])).alias("b")).select("b.*")
        out = known.join(F.broadcast(out.drop("name", "is_own")), "brand_ord", "left").na.fill(0)
    pool = F.sum("mentions").over(Window.partitionBy(*keys))
    share = lambda x, y: F.when(y > 0, 100.0 * x / y).otherwise(0.0)
    return out.select(
        *keys, "brand_ord", "name", "is_own", "total", "responses_present", "mentions", share(F.col("responses_present"), F.col("total")).alias("visibility"), share(F.col("mentions"), pool).alias("share_of_voice"),
        F.when(F.col("_ranked") > 0, F.col("_ranks") / F.col("_ranked")).alias("avg_position"), "citations", "source_responses", share(F.col("source_responses"), F.col("total")).alias("source_visibility"),
        F.lit(None).cast("double").alias("sentiment"),
    )


def brand_series(records: DataFrame, brands: list[Brand], bucket: str = "day") -> DataFrame:
    """The same per UTC day or Monday week; buckets without a response do not appear."""
    return brand_metrics(records, brands, {"bucket": (week_key if bucket == "week" else day_key)(F.col("captured_at"))})


def ordered_series(series: DataFrame) -> DataFrame:
    """A series by bucket, then in list order."""
    return series.orderBy("bucket", "brand_ord")


def ordered(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("is_own"), F.desc("visibility"), "brand_ord")


def _n(array: str, test) -> Column:
    return F.size(F.filter(array, test))


def overview(records: DataFrame) -> DataFrame:
    """One row: responses, those whose flag says they searched, fan-out queries, sources by outcome, distinct domains.

    One pass: each record gives its numbers once, and its distinct domains beside them.
    """
    queries = sum((F.coalesce(F.size(f"fanout.{b}"), F.lit(0)) for b in ("search", "shopping", "image")), F.lit(0))
    domains = F.filter(F.array_distinct(F.coalesce("sources.domain", F.array().cast("array<string>"))), lambda d: d != "")
    # The first row of a record carries its numbers; further rows only a domain each.
    each = records.select(F.coalesce("searched", F.lit(False)).alias("searched"), queries.alias("fan"), _n("sources", lambda s: s["outcome"] == "cited").alias("cited"), _n("sources", lambda s: s["outcome"] == "fetched").alias("fetched"), F.posexplode_outer(domains).alias("k", "d"))
    first = F.coalesce(F.col("k"), F.lit(0)) == 0
    total = lambda c: F.coalesce(F.sum(F.when(first, F.col(c))), F.lit(0)).cast("long")
    return each.agg(F.count_if(first).alias("captures"), F.count_if(first & F.col("searched")).alias("searched"), total("fan").alias("fanout"), total("cited").alias("cited"), total("fetched").alias("fetched"), F.countDistinct("d").alias("unique_domains"))


def prompt_performance(records: DataFrame, brands: list[Brand]) -> DataFrame:
    """Every response to a tracked prompt, newest first within a prompt (``run`` counts from 1): the own brand's presence, place and citation, and the sources.

    Without an own brand it is not mentioned anywhere.
    """
    df = presence(records.where(F.coalesce(F.col("prompt_id").cast("string") != "", F.lit(False))), brands)
    own = F.get(F.filter("brands", lambda b: b["is_own"]), F.lit(0))
    newest = Window.partitionBy("prompt_id").orderBy(F.desc("captured_at"), F.desc("capture_id"))
    sources = F.transform("sources", lambda s: F.struct(s["domain"].alias("domain"), s["url"].alias("url"), s["outcome"].alias("outcome")))
    return df.select("prompt_id", F.row_number().over(newest).alias("run"), "capture_id", "captured_at", "platform", F.coalesce(own["present"], F.lit(False)).alias("mentioned"), own["rank"].alias("position"), F.coalesce(own["cited"], F.lit(False)).alias("cited"), sources.alias("sources"))


def latest_performance(records: DataFrame, brands: list[Brand]) -> DataFrame:
    """The own brand in the latest response of each prompt and engine; combines before the shuffle."""
    df = presence(records, brands).withColumn("own", F.get("brands", F.lit(0)))
    latest = df.groupBy("prompt_id", "platform").agg(F.max(F.struct("captured_at", "capture_id", F.col("own.present").alias("present"), F.col("own.rank").alias("rank"), F.col("own.cited").alias("cited"), F.size("sources").alias("n_sources"))).alias("x"), F.count("*").alias("runs"))
    return latest.select("prompt_id", "platform", "runs", "x.captured_at", "x.capture_id", "x.present", "x.rank", "x.cited", "x.n_sources")


def url_detail(records: DataFrame, url: str, brands: list[Brand], prompts: DataFrame) -> DataFrame:
    """Which responses used a URL, newest first: their prompt's text (or a default), whether the own brand is mentioned (null without one), and the tracked brands present."""
    df = presence(records.where(F.exists("sources", lambda s: s["url"] == url)), brands)
    names = F.array_join(F.transform(F.filter("brands", lambda b: b["present"]), lambda b: b["name"]), ", ")
    own = F.get(F.filter("brands", lambda b: b["is_own"]), F.lit(0))
    df = df.join(prompts, "prompt_id", "left").select("capture_id", "captured_at", "platform", F.coalesce("prompt_text", F.lit("(prompt no longer tracked)")).alias("prompt_text"), own["present"].alias("mentioned"), names.alias("brands_present"))
    return df.orderBy(F.desc("captured_at"), F.desc("capture_id"))


def percent_text(c: Column) -> Column:
    """A share as it is shown: one decimal and a percent sign, a dash for none."""
    return F.when(c.isNull(), "–").otherwise(F.format_string("%.1f%%", c.cast("double")))


def position_text(c: Column) -> Column:
    """An average place as it is shown: ``#`` and one decimal, a dash for none."""
    return F.when(c.isNull(), "–").otherwise(F.format_string("#%.1f", c.cast("double")))


def completed(records: DataFrame) -> DataFrame:
    """Turns with a signal by run and platform."""
    return records.where(has_signal(records) & F.col("geo.run_id").isNotNull()).groupBy(F.col("geo.run_id").alias("run_id"), "platform").agg(F.count("*").alias("completed"))
