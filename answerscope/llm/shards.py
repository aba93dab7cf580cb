"""Sharding by size-tiered compaction with a versioned manifest.

A store is a folder in a file system that Spark reaches.  An arrival is
appended as small immutable shards (as the tasks that hold it write them;
nothing is shuffled).  Compaction looks only at the sizes in the manifest:
shards smaller than the target are dealt into tiers by the logarithm of their
size, and when a tier has ``fan_in`` of them or more they are merged into files
of about the target size, until no tier is full.  A merge reads and rewrites
its shards without a shuffle.

A version is one small file ``v<n>.json`` that lists immutable manifest parts
of up to ``PART`` shards each; a change writes only the parts that it touches.
The version file is written under a temporary name and then moved to a name
that must not exist yet, in one step of the file system (a hard link on a local
one, a rename without overwriting elsewhere).  Of two writers of one version the
second gets ``Conflict``, reads the newer version and commits its change on top
of that: an append is never lost, and a merge whose shards are gone by then is
given up.  Readers see the old or the new set of shards, never a mix.  Shards
and parts that no version names are harmless leftovers of writers that failed.

Defined cases: an empty arrival commits a version with no new shard; nulls,
repeated rows and extra columns (any names) are stored as they are; a store
without any version has none to read; the first arrival fixes the schema; very
long texts are part of their row, so a shard holds one row at least.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Conflict, Files

#: Shards that one manifest part lists.
PART = 10_000


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    tier: int
    born: int  # the version that added it


class ShardStore:
    full = 8

    def __init__(self, spark: SparkSession, root: str, target: int = 128 << 20, fan_in: int = 4, base: int = 4):
        self.spark, self.root, self.target, self.fan_in, self.base = spark, root.rstrip("/"), target, fan_in, base
        self._files = Files(spark, self.root)

    # -- manifests ---------------------------------------------------------
    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._files.names("manifest") if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        """The newest version; 0 where there is none."""
        return (self.versions() or [0])[-1]

    def parts(self, version: int) -> list[str]:
        """The manifest parts of a version."""
        return self._files.read(f"manifest/v{version}.json")["parts"] if version else []

    def _part(self, name: str) -> list[Shard]:
        return [Shard(**x) for x in self._files.read(f"manifest/{name}")]

    def shards(self, version: int | None = None) -> list[Shard]:
        return [s for p in self.parts(self.latest() if version is None else version) for s in self._part(p)]

    def commit(self, version: int, gone: set[Shard], new: list[Shard]) -> None:
        """Commits ``version`` as the one before it without the shards ``gone`` and with the ``new`` ones, or raises ``Conflict``.

        Parts without a shard that goes are kept by name; the last one takes new shards while it is not full.
        """
        kept: list[str] = []
        old = self.parts(version - 1)
        for k, name in enumerate(old):
            own = self._part(name) if gone or k == len(old) - 1 else None
            if own is None or (not gone.intersection(own) and (k < len(old) - 1 or len(own) >= PART or not new)):
                kept.append(name)
            else:
                new = [s for s in own if s not in gone] + new
        for at in range(0, len(new), PART):
            name = f"p-{uuid.uuid4().hex}.json"
            self._files.write(f"manifest/{name}", [asdict(s) for s in new[at : at + PART]])
            kept.append(name)
        self._files.claim(f"manifest/v{version}.json", {"version": version, "parts": kept})

    # -- writing -----------------------------------------------------------
    def tier_of(self, size: int) -> int:
        """Files of the target size or more are in tier ``full``; each tier below is ``base`` times smaller, down to 0."""
        if size >= self.target:
            return self.full
        return max(0, self.full - 1 - int(math.log(self.target / max(size, 1), self.base)))

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        folder = f"data/{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return [Shard(p, n, self.tier_of(n), version) for p, n in self._files.sizes(folder) if p.endswith(".parquet") and "/part-" in p]

    def append(self, arrival: DataFrame) -> int:
        """The version that added the arrival."""
        new = self._write(arrival, self.latest() + 1)
        while True:
            version = self.latest() + 1
            try:
                self.commit(version, set(), [replace(s, born=version) for s in new])
                return version
            except Conflict:
                continue  # on top of what the other writer committed

    def _full_tier(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the lowest tier that has enough to merge."""
        by: dict[int, list[Shard]] = {}
        for s in shards:
            if s.tier < self.full:
                by.setdefault(s.tier, []).append(s)
        return next((x for _, x in sorted(by.items()) if len(x) >= self.fan_in), [])

    def compact(self) -> list[int]:
        """Merges until no tier below the full one holds ``fan_in`` shards; the versions that this made."""
        made = []
        while run := self._full_tier(self.shards(base := self.latest())):
            files = max(1, round(sum(s.size for s in run) / self.target))
            if files >= len(run):
                break  # as large as they can get at this target
            merged = self._write(self.spark.read.parquet(*[s.path for s in run]).coalesce(files), base + 1)
            # What was merged counts as one tier up at least, so that uneven outputs end the loop.
            up = [replace(m, tier=max(m.tier, run[0].tier + 1)) for m in merged]
            while True:
                try:
                    self.commit(base + 1, set(run), [replace(m, born=base + 1) for m in up])
                    made.append(base + 1)
                    break
                except Conflict:
                    base = self.latest()
                    if not set(run) <= set(self.shards(base)):
                        break  # another compaction has merged them
        return made

    def vacuum(self) -> int:
        """Deletes data files that the latest manifest does not name; not while older versions are being read or written."""
        live, gone = {s.path for s in self.shards()}, 0
        for folder in self._files.names("data"):
            for path, _ in self._files.sizes(f"data/{folder}"):
                if path.endswith(".parquet") and path not in live:
                    gone += self._files.delete(f"data/{folder}/{path.rsplit('/', 1)[1]}")
        return gone

    def drop(self) -> None:
        """Deletes the store."""
        self._files.delete()

    # -- reading -----------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.shards(version)]
        if not paths:
            raise FileNotFoundError(f"no shard in {self.root}")
        return self.spark.read.parquet(*paths)


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` as ``n`` arrivals of about equal size, dealt by a hash of the id (null ids come with the first)."""
    k = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("arrival")), F.lit(n)), F.lit(0))
    return [docs.where(k == i) for i in range(n)]
