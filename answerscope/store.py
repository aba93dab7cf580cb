"""Tables, lifecycle operations and settings.

A table is cut into buckets by a hash of its key.  A change rewrites only the
buckets that hold touched keys, into a folder of its own, and then claims the
next version: a small file that names the folder of every bucket.  A write that
is killed before the claim leaves a folder that nothing names; a writer that
finds its version taken does its change again on top of the newer one, so no
update is lost.  The last ``KEPT`` versions stay readable, older folders go.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import Conflict, Files
from .functions.text import duplicate_key
from .operators.intervals import last_span

MAX_PROFILES, TRASH_DAYS = 3, 7


@dataclass(frozen=True)
class Settings:
    my_brand: str = ""
    competitors: tuple[str, ...] = ()
    debug_capture: bool = False
    max_capture_mb: int = 8
    retention_max: int = 2000

    def patch(self, **changes) -> "Settings":
        new = replace(self, **{k: v for k, v in changes.items() if v is not None})
        return replace(new, max_capture_mb=max(1, new.max_capture_mb), retention_max=max(50, new.retention_max))


class Table:
    """A keyed table in versions; readers of a recent version are not disturbed."""

    KEPT, TRIES = 3, 20

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 1, newest: str | None = None):
        """newest: of rows of one batch with equal keys, that with the greatest value of this column stays."""
        self.spark, self.path, self.key, self.schema, self.buckets, self.newest = spark, path.rstrip("/"), key, schema, buckets, newest
        self.columns = [f.name for f in StructType.fromDDL(schema)]
        self._files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._files.names("versions") if n.startswith("v") and n.endswith(".json"))

    def _state(self) -> tuple[int, dict[str, str]]:
        """The newest version and the folder of each bucket that has rows."""
        have = self.versions()
        return (have[-1], self._files.read(f"versions/v{have[-1]}.json")) if have else (0, {})

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._rows(list(self._state()[1].values()))

    def change(self, f: Callable[[DataFrame], DataFrame], touched: list[int] | None = None) -> int:
        """Rewrites the touched buckets (None: all) as ``f`` of their rows; the new version.  ``f`` may run again after a conflict."""
        for _ in range(self.TRIES):
            version, state = self._state()
            own = {b: x for b, x in state.items() if touched is None or int(b) in touched}
            folder = f"data/{uuid.uuid4().hex}"
            f(self._rows(list(own.values()))).select(self.columns).withColumn("_b", self._bucket()).write.partitionBy("_b").parquet(f"{self.path}/{folder}")
            new = {n[3:]: f"{folder}/{n}" for n in self._files.names(folder) if n.startswith("_b=")}
            try:
                self._files.claim(f"versions/v{version + 1}.json", {**{b: x for b, x in state.items() if b not in own}, **new})
            except Conflict:
                self._files.delete(folder)
                continue
            self._forget(version + 1)
            return version + 1
        raise Conflict(f"{self.path}: {self.TRIES} writers were faster")

    def _forget(self, version: int) -> None:
        """Deletes versions older than the last ``KEPT`` and the folders that only they name."""
        old = [v for v in self.versions() if v <= version - self.KEPT]
        if not old:
            return
        named = lambda vs: {x.split("/_b=")[0] for v in vs for x in self._files.read(f"versions/v{v}.json").values()}
        gone = named(old) - named([v for v in self.versions() if v not in old])
        for x in gone:
            self._files.delete(x)
        for v in old:
            self._files.delete(f"versions/v{v}.json")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # a number a bucket at most

    def replace(self, df: DataFrame) -> None:
        self.change(lambda _: df)

    def upsert(self, rows: DataFrame) -> None:
        """New rows replace those of equal keys; of equal keys in the batch one row stays."""
        have = set(rows.columns)
        rows = rows.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in self.columns]).to(StructType.fromDDL(self.schema))
        order = ([F.desc_nulls_last(self.newest)] if self.newest else []) + [F.xxhash64(*[F.to_json(F.struct(c)) for c in self.columns])]
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(self.key).orderBy(*order))).where("_r = 1").drop("_r").persist()
        try:
            if touched := self._touched(rows):
                self.change(lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows), touched)
        finally:
            rows.unpersist()

    def delete(self, keys: DataFrame) -> None:
        keys = keys.select(self.key).distinct().persist()
        try:
            if touched := self._touched(keys):
                self.change(lambda old: old.join(keys, self.key, "left_anti"), touched)
        finally:
            keys.unpersist()

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))

    def get(self, key) -> DataFrame:
        """The row of a key; only its bucket is read."""
        bucket = self.spark.range(1).select(F.lit(key).alias(self.key)).select(self._bucket()).head()[0]
        folder = self._state()[1].get(str(bucket))
        return self._rows([folder] if folder else []).where(F.col(self.key) == key)

    def keys(self, order: str | None = None, limit: int | None = None) -> DataFrame:
        df = self.read()
        df = df.orderBy(order).select(self.key) if order else df.select(self.key)
        return df.limit(limit) if limit else df

    def stats(self) -> int:
        return self.read().count()


def make_prompt(df: DataFrame) -> DataFrame:
    """Trimmed text; tags trimmed, distinct and not empty; active unless false."""
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array()), lambda t: F.trim(t)), lambda t: t != ""))
    return df.withColumn("text", F.trim("text")).withColumn("tags", tags).withColumn("active", F.coalesce("active", F.lit(True)))


def bulk_add(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``new`` with ``status``: ``added``, or ``duplicate`` of an existing prompt or of one before it in the batch."""
    known = existing.select(duplicate_key(F.col("text")).alias("_k")).distinct().withColumn("_known", F.lit(True))
    df = new.withColumn("_k", duplicate_key(F.col("text"))).join(known, "_k", "left")
    first = F.row_number().over(Window.partitionBy("_k").orderBy(order)) == 1
    return df.withColumn("status", F.when(F.col("_known").isNull() & first, "added").otherwise("duplicate")).drop("_k", "_known")


def rename_tag(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("tags", F.array_distinct(F.transform("tags", lambda t: F.when(t == old, new).otherwise(t))))


def delete_tag(df: DataFrame, tag: str) -> DataFrame:
    return df.withColumn("tags", F.array_remove("tags", tag))


def all_tags(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def add_tag(df: DataFrame, tag: str) -> DataFrame:
    """The union of a prompt's tags and one more, trimmed; an empty one adds nothing."""
    tag = F.trim(F.lit(tag))
    return df.withColumn("tags", F.when(tag == "", F.col("tags")).otherwise(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(tag))))


def filter_prompts(df: DataFrame, search: str = "", untagged: bool = False, tags: tuple[str, ...] = ()) -> DataFrame:
    """Prompts whose text holds ``search`` in any case, without a tag if asked for, and with any of ``tags``."""
    own = F.coalesce("tags", F.array().cast("array<string>"))
    if search:
        df = df.where(F.contains(F.lower("text"), F.lit(search.lower())))
    if untagged:
        df = df.where(F.size(own) == 0)
    if tags:
        df = df.where(F.arrays_overlap(own, F.array(*map(F.lit, tags))))
    return df


def stamp(captures: DataFrame, positions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Provenance of captures (one row an id) from where their run stood.

    ``positions(platform, run_id, profile_id, ordinal, since, until)`` holds the spans in which a platform was at a prompt of a
    run; ``prompts(run_id, ordinal, prompt_id, tags)`` the run's list.  Of several spans the one that began last counts.  A
    capture outside every span has none, and one that has its provenance keeps it.
    """
    last = last_span(captures, positions, "capture_id", ["platform"], "captured_at", "since", "until", ["run_id", "ordinal", "profile_id"])
    at = last.select("capture_id", "last.run_id", "last.profile_id", "last.ordinal").join(prompts, ["run_id", "ordinal"], "left")
    geo = F.struct("profile_id", "run_id", "prompt_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    df = captures.join(at.select("capture_id", geo.alias("_geo")), "capture_id", "left")
    own = [F.col("geo")] if "geo" in captures.columns else []
    return df.select(*[c for c in captures.columns if c != "geo"], F.coalesce(*own, "_geo").alias("geo"))


def move(positions: DataFrame, platform: str, now_ms: int, to: DataFrame | None = None) -> DataFrame:
    """``positions`` after a platform has left where it was, for ``to`` (one row) if it goes on."""
    now = F.timestamp_millis(F.lit(now_ms))
    left = (F.col("platform") == platform) & F.col("until").isNull() & (F.col("since") <= now)
    out = positions.withColumn("until", F.when(left, now).otherwise(F.col("until")))
    return out if to is None else out.unionByName(to)


def run_prompts(runs: DataFrame) -> DataFrame:
    """``run_id, ordinal, prompt_id, tags`` from the index-aligned lists of ``runs(run_id, prompt_ids, prompt_tags)``; a list that is shorter ends in nulls."""
    pairs = F.arrays_zip(F.col("prompt_ids").alias("prompt_id"), F.col("prompt_tags").alias("tags"))
    return runs.select("run_id", F.posexplode(pairs).alias("ordinal", "x")).select("run_id", "ordinal", "x.prompt_id", "x.tags")


def reason_histogram(df: DataFrame, run: str, reason: str) -> DataFrame:
    per = df.groupBy(run, reason).agg(F.count("*").alias("n"))
    return per.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(reason), F.col("n"))))).alias("reasons"), F.sum("n").alias("failed"))


@dataclass
class Profile:
    id: str
    name: str
    brand: dict
    competitors: list[dict] = field(default_factory=list)
    engines: list[str] = field(default_factory=list)
    locked: bool = False
    created_at: int = 0
    last_run_at: int | None = None
    deleted_at: int | None = None


class Profiles:
    """Campaign profiles: a handful of rows, so they live on the driver and are stored as one JSON text."""

    def __init__(self, rows: list[Profile] | None = None):
        self.rows = {p.id: p for p in rows or []}

    def live(self) -> list[Profile]:
        return sorted((p for p in self.rows.values() if p.deleted_at is None), key=lambda p: p.created_at)

    def save(self, profile: Profile, override: bool = False) -> Profile:
        from .operators.metrics import ENGINES

        old = self.rows.get(profile.id)
        if old and old.locked and not override:
            raise ValueError("the profile is locked")
        if not old and len(self.live()) >= MAX_PROFILES:
            raise ValueError(f"{MAX_PROFILES} profiles at most")
        usable = [e for e, ok in ENGINES.items() if ok]
        profile.engines = [e for e in profile.engines if e in usable] or usable
        profile.competitors = [c for c in profile.competitors if (c.get("name") or "").strip()]
        self.rows[profile.id] = profile
        return profile

    def merge(self, fields: dict, override: bool = False) -> Profile:
        """``save`` with these fields over those of the profile of the same id."""
        old = self.rows.get(fields.get("id"))
        return self.save(Profile(**({**asdict(old), **fields} if old else fields)), override)

    def trash(self, key: str, now_ms: int) -> None:
        self.rows[key].deleted_at = now_ms

    def restore(self, key: str) -> None:
        if len(self.live()) >= MAX_PROFILES:
            raise ValueError(f"{MAX_PROFILES} profiles at most")
        self.rows[key].deleted_at = None

    def purge(self, now_ms: int) -> list[str]:
        """Ids of profiles in the trash for longer than ``TRASH_DAYS``; their prompts go too, captures stay."""
        gone = [k for k, p in self.rows.items() if p.deleted_at is not None and p.deleted_at < now_ms - TRASH_DAYS * 86_400_000]
        for k in gone:
            del self.rows[k]
        return gone

    def dumps(self) -> str:
        return json.dumps([asdict(p) for p in self.rows.values()])

    @classmethod
    def loads(cls, text: str) -> "Profiles":
        return cls([Profile(**p) for p in json.loads(text)])


def start_run(profile: Profile, prompts: int, running: bool = False) -> dict:
    """Checks that a run can start; the run row with its expected count."""
    if running:
        raise ValueError("a run is in progress")
    if not (profile.brand or {}).get("name"):
        raise ValueError("the profile has no brand")
    if not prompts:
        raise ValueError("no active prompt")
    if not profile.engines:
        raise ValueError("no supported engine")
    return {"profile_id": profile.id, "status": "running", "engines": profile.engines, "expected": prompts * len(profile.engines), "captured": 0, "failed": 0, "reasons": {}}
