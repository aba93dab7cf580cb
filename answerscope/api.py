"""One entry for all commands: a name and arguments in, ``{"ok": ..., ...}`` out."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files, scratch
from .operators import metrics as M
from .schema import DERIVED, RAW, light
from .sources.exports import diagnostics
from .sources.payloads import derive, landing
from .store import Profile, Profiles, Settings, Table, add_tag, all_tags, bulk_add, delete_tag, filter_prompts, make_prompt, move, rename_tag, run_prompts, stamp, start_run
from .streaming import ingest, turns
from .streaming.turns import OUTCOME

PROMPTS = "id string, profile_id string, text string, tags array<string>, active boolean, created_at bigint"
RUNS = "id string, profile_id string, status string, started_at bigint, finished_at bigint, engines array<string>, prompt_ids array<string>, expected bigint, captured bigint, failed bigint, reasons map<string,bigint>, prompt_tags array<array<string>>"
POSITIONS = "id string, platform string, run_id string, profile_id string, ordinal int, since timestamp, until timestamp"
PROJECTS = "id string, name string, prompts array<string>, created_at bigint, updated_at bigint"
OUTCOMES = f"id string, {OUTCOME}"
ERRORS = "capture_id string, error string"
DEBUG = "id string, at bigint, event string"
#: Entries that the debug log keeps and shows.
LOGGED, SHOWN = 200, 120


#: Buckets of the capture tables: a batch rewrites those that hold its keys.
BUCKETS = 64


class Engine:
    """The tables of one store below ``root`` and the commands over them; large results stay DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        table = lambda name, key, schema, *how: Table(spark, f"{root}/{name}", key, schema, *how)
        self.raw, self.derived = table("raw", "capture_id", RAW, BUCKETS, "captured_at"), table("derived", "capture_id", DERIVED, BUCKETS, "captured_at")
        self.state = table("state", "name", "name string, value string")
        kept = {r["name"]: r["value"] for r in self.state.read().collect()}  # two rows
        self.settings = Settings(**json.loads(kept["settings"])) if "settings" in kept else Settings()
        self.profiles = Profiles.loads(kept["profiles"]) if "profiles" in kept else Profiles()
        self.prompts, self.runs, self.projects = table("prompts", "id", PROMPTS), table("runs", "id", RUNS), table("projects", "id", PROJECTS)
        self.positions, self.outcomes = table("positions", "platform", POSITIONS), table("outcomes", "id", OUTCOMES)
        self.errors, self.log = table("errors", "capture_id", ERRORS), table("debug", "id", DEBUG)
        self.commands: dict[str, Callable] = {
            "raw-conversation": self.capture, "get-records": lambda: light(self.derived.read()).orderBy(F.desc("captured_at")), "get-record": self.derived.get, "get-raw": self.raw.get,
            "stats": lambda: {"raw": self.raw.stats(), "derived": self.derived.stats()}, "reprocess-all": self.reprocess, "delete-record": self.delete, "clear-all": self.clear,
            "settings-get": lambda: self.settings, "settings-set": self.patch, "project-save": self.projects.upsert, "project-list": lambda: self.projects.read().orderBy(F.desc("updated_at")), "project-delete": self.projects.delete,
            "profile-list": self.list_profiles, "profile-save": lambda override=False, **p: self.keep_profiles(self.profiles.merge(p, override)), "profile-trash": lambda **a: self.keep_profiles(self.profiles.trash(**a)), "profile-restore": lambda **a: self.keep_profiles(self.profiles.restore(**a)), "profile-delete": self.delete_profile,
            "prompt-list": lambda profile_id: self.prompts.read().where(F.col("profile_id") == profile_id).orderBy("created_at"), "prompt-save": lambda rows: self.prompts.upsert(make_prompt(rows)), "prompt-bulk-add": self.add_prompts, "prompt-delete": self.prompts.delete,
            "tag-add": lambda prompt_id, tag: self.prompts.change(lambda old: old.where(F.col("id") != prompt_id).unionByName(add_tag(old.where(F.col("id") == prompt_id), tag))), "prompt-filter": lambda profile_id, **by: filter_prompts(self.prompts.read().where(F.col("profile_id") == profile_id), **by), "tag-list": lambda: all_tags(self.prompts.read()), "tag-delete": lambda tag: self.prompts.change(lambda old: delete_tag(old, tag)), "tag-rename": lambda old, new: self.prompts.change(lambda rows: rename_tag(rows, old, new)),
            "run-list": lambda: self.runs.read().orderBy(F.desc(F.coalesce("started_at", F.lit(0)))), "run-start": self.start, "run-sync": self.sync, "run-position": self.position, "run-track": lambda events, checkpoint: ingest.track(events, self.outcomes.upsert, checkpoint).awaitTermination(), "run-status": lambda: turns.run_status(self.outcomes.read(), self.platforms()), "run-progress": self.progress, "get-errors": self.errors.read, "debug": self.debug, "get-debug": self.debug, "clear-debug": self.log.clear, "diagnostics": lambda: diagnostics(self.raw.read(), self.derived.read(), self.runs.read()), "metrics": self.metrics, "prompt-performance": lambda brands, **scope: M.prompt_performance(self.scoped(**scope), brands),
            "url-detail": lambda url, brands, **scope: M.url_detail(self.scoped(**scope), url, brands, self.prompts.read().select(F.col("id").alias("prompt_id"), F.col("text").alias("prompt_text"))),
        }

    def handle(self, command: str, **args) -> dict:
        """Unknown commands and errors answer ``ok: False``; nothing is raised."""
        f = self.commands.get(command)
        if f is None:
            return {"ok": False, "error": f"unknown command {command}"}
        try:
            return {"ok": True, "result": f(**args)}
        except Exception as e:  # noqa: BLE001  the caller gets the error
            return {"ok": False, "error": f"{type(e).__name__}: {e}"}

    def tracked(self) -> list[dict]:
        """The labels of the settings: own brand first."""
        own = [{"name": self.settings.my_brand, "relation": "own"}] if self.settings.my_brand else []
        return own + [{"name": c, "relation": "competitor"} for c in self.settings.competitors if c]

    def capture(self, rows: DataFrame) -> None:
        """Raw rows first, stamped with where their run stands, then their records; the oldest beyond the retention limit go."""
        usable, _ = landing(rows, self.settings.max_capture_mb)
        usable = stamp(usable, self.positions.read(), run_prompts(self.runs.read().withColumnRenamed("id", "run_id")))
        self.raw.upsert(usable.select(*self.raw.columns))
        self._derived(usable, lambda good, _: self.derived.upsert(good))
        self.enforce_retention()

    def enforce_retention(self) -> int:
        """How many captures went, from both tables."""
        over = self.derived.stats() - max(50, self.settings.retention_max)
        if over <= 0:
            return 0
        # Runs after every capture, so what is over is what one batch brought.
        oldest = self.derived.read().orderBy(F.asc_nulls_first("captured_at"), "capture_id").limit(over).select("capture_id").persist()
        self.raw.delete(oldest)
        self.derived.delete(oldest)
        oldest.unpersist()
        return over

    def _derived(self, raw: DataFrame, store: Callable[[DataFrame, DataFrame], object]) -> tuple[int, int]:
        """Gives ``store`` the records of raw rows and the ids of those that can't be read; how many there are of each.

        Payloads are decoded once, into the shared folder.  An error stays in a table of its own until its capture can be read.
        """
        folder = f"{scratch(self.spark)}/derived-{uuid.uuid4().hex}"
        derive(raw, self.tracked()).write.parquet(folder)
        done = self.spark.read.parquet(folder)
        good, bad = done.where("error is null").drop("error"), done.where("error is not null").select("capture_id", "error")
        store(good, bad.select("capture_id"))
        self.errors.change(lambda old: old.join(done.select("capture_id"), "capture_id", "left_anti").unionByName(bad))
        counts = good.count(), bad.count()
        Files(self.spark, folder).delete()
        return counts

    def reprocess(self) -> dict[str, int]:
        """All raw rows again; provenance comes from the raw row.  A capture that can't be read keeps its old record, and its error is kept aside."""
        good, bad = self._derived(self.raw.read(), lambda good, bad: self.derived.change(lambda old: old.join(bad, "capture_id", "left_semi").select(good.columns).unionByName(good)))
        return {"total": good + bad, "reprocessed": good}

    def debug(self, rows: DataFrame | None = None) -> DataFrame | None:
        """Adds ``rows(id, at, event)`` to the debug log, which keeps its newest entries; without rows, the newest that are shown, oldest first."""
        newest = [F.desc("at"), F.desc("id")]
        if rows is None:
            return self.log.read().orderBy(*newest).limit(SHOWN).orderBy("at", "id")
        self.log.change(lambda old: old.unionByName(rows.select(old.columns)).orderBy(*newest).limit(LOGGED))
        return None

    def delete(self, keys: DataFrame) -> None:
        for table in (self.raw, self.derived, self.errors):
            table.delete(keys)

    def clear(self) -> None:
        """Captures, records and runs; profiles, prompts and settings stay."""
        for table in (self.raw, self.derived, self.runs, self.positions, self.outcomes, self.errors):
            table.clear()

    def _keep(self, name: str, value: str) -> None:
        self.state.upsert(self.spark.createDataFrame([(name, value)], "name string, value string"))

    def keep_profiles(self, result=None):
        """Stores the profiles after a change."""
        self._keep("profiles", self.profiles.dumps())
        return result

    def patch(self, **changes) -> Settings:
        self.settings = self.settings.patch(**changes)
        self._keep("settings", json.dumps(asdict(self.settings)))
        return self.settings

    def list_profiles(self, now_ms: int, with_deleted: bool = False) -> list[Profile]:
        gone = self.profiles.purge(now_ms)
        if gone:
            self.prompts.change(lambda old: old.where(~F.col("profile_id").isin(gone)))
            self.keep_profiles()
        return sorted(self.profiles.rows.values(), key=lambda p: p.created_at) if with_deleted else self.profiles.live()

    def delete_profile(self, key: str) -> None:
        """Its prompts go with it, what was captured stays."""
        del self.profiles.rows[key]
        self.keep_profiles()
        self.prompts.change(lambda old: old.where(F.col("profile_id") != key))

    def add_prompts(self, rows: DataFrame) -> dict[str, int]:
        df = bulk_add(self.prompts.read(), make_prompt(rows), "id")
        self.prompts.upsert(df.where("status = 'added'").drop("status"))
        return {r["status"]: r["count"] for r in df.groupBy("status").count().collect()}

    def start(self, profile_id: str, now_ms: int = 0) -> dict:
        """Stores the row of a new run; one run at a time."""
        active = [r for r in self.prompts.read().where((F.col("profile_id") == profile_id) & F.coalesce("active", F.lit(True))).orderBy("created_at", "id").select("id", "tags").collect()]  # one campaign's prompts
        running = bool(self.runs.read().where("status = 'running'").head(1))
        profile = self.profiles.rows[profile_id]
        row = {"id": f"{profile_id}-{now_ms}-{uuid.uuid4().hex[:8]}", "started_at": now_ms, "finished_at": None, "prompt_ids": [r["id"] for r in active], "prompt_tags": [r["tags"] for r in active], **start_run(profile, len(active), running)}
        self.runs.upsert(self.spark.createDataFrame([tuple(row[c] for c in self.runs.columns)], RUNS))
        profile.last_run_at = now_ms
        self.keep_profiles()
        return row

    def sync(self, run_id: str, captured: int, failed: int, reason: str | None = None, count: int = 1, status: str | None = None, now_ms: int | None = None) -> None:
        """Counts, a reason for failures and a final status onto a run's row; of several writers none is lost, as each change starts from the newest version."""

        def onto(old: DataFrame) -> DataFrame:
            own = F.col("id") == run_id
            keep = lambda c, v: F.when(own, v).otherwise(F.col(c))
            had = F.coalesce("reasons", F.create_map().cast("map<string,bigint>"))
            more = F.map_zip_with(had, F.create_map(F.lit(reason), F.lit(count).cast("bigint")), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if reason else had
            new = {"captured": F.lit(captured).cast("bigint"), "failed": F.lit(failed).cast("bigint"), "reasons": more}
            if status:
                new |= {"status": F.lit(status), "finished_at": F.lit(now_ms).cast("bigint")}
            return old.withColumns({c: keep(c, v) for c, v in new.items()})

        self.runs.change(onto)
        if status and status != "running":
            now = F.timestamp_millis(F.lit(now_ms)) if now_ms is not None else F.current_timestamp()
            self.positions.change(lambda old: old.withColumn("until", F.when(F.col("run_id") == run_id, F.coalesce("until", now)).otherwise(F.col("until"))))

    def position(self, run_id: str, platform: str, ordinal: int, now_ms: int) -> None:
        """A platform of a run is at the prompt of this ordinal from now on; beyond the last one it is nowhere."""
        run = self.runs.get(run_id).select("profile_id", F.size("prompt_ids").alias("n")).head()
        if run is None:
            raise ValueError("no such run")
        at = dt.datetime.fromtimestamp(now_ms / 1000, dt.timezone.utc)
        row = self.spark.createDataFrame([(f"{run_id}-{platform}-{ordinal}-{now_ms}", platform, run_id, run["profile_id"], ordinal, at, None)], POSITIONS)
        self.positions.change(lambda old: move(old, platform, now_ms, row if ordinal < run["n"] else None))

    def platforms(self) -> DataFrame:
        """A row a run and platform, with the number of its prompts."""
        return self.runs.read().select(F.col("id").alias("run_id"), F.explode("engines").alias("platform"), F.size("prompt_ids").cast("bigint").alias("total"))

    def progress(self, run_id: str) -> DataFrame:
        """What became of each prompt of a run on each of its platforms."""
        own = self.runs.get(run_id).select(F.col("id").alias("run_id"), F.explode("engines").alias("platform"), "prompt_ids")
        prompts = own.select("run_id", "platform", F.posexplode("prompt_ids").alias("ordinal", "prompt_id")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
        return turns.progress(prompts, self.outcomes.read().where(F.col("run_id") == run_id))

    def scoped(self, **scope) -> DataFrame:
        return M.select_tracked(self.derived.read().withColumn("prompt_id", F.col("geo.prompt_id")), **scope)

    def metrics(self, brands: list[M.Brand], bucket: str = "day", **scope) -> dict[str, DataFrame]:
        df = self.scoped(**scope)
        return {"brands": M.ordered(M.brand_metrics(df, brands)), "series": M.ordered_series(M.brand_series(df, brands, bucket)), "overview": M.overview(df)}
