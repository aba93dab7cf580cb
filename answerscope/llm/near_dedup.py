"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Each text gets the set of its word shingles, a digest of the whole set and a
   signature of MinHash values (64; more below 13 %, see ``matching``).  Texts with equal sets are one
   class from here on, by a grouping on the digest that combines before the
   shuffle; a class of any number of copies is one row.
2. Classes are posted under (coordinate, value) pairs.  A pair of classes at
   the threshold agrees in ``matches`` coordinates or more, except with a
   probability of at most ``MISS``, so it shares one of the ``coordinates -
   matches + 1`` first coordinates of either in any common order (prefix
   filter).  ``matching`` derives both numbers from the threshold.  The order is rarest first, by a fixed-size count sketch over all
   rows, so values that a large part of the corpus shares are not posted.
   Lists of one class are skipped.
3. In each list, collisions over all coordinates are counted and classes with
   ``matches`` or more are connected.  Only a spanning forest is made: the
   classes outside the part that is largest in the end are compared with all, so
   a large group of near copies is gone through once, not in all pairs.
4. The connected candidates are confirmed on their full shingle sets, again
   component by component, emitting a spanning forest of the links that hold.
   Every pair of candidates is either confirmed, refuted, or already connected.

A group of steps 3 and 4 (a list, a component) that is larger than a block
(``BLOCK`` rows or ``BLOCK_BYTES`` of texts) is not held in one task.  All its
members are first compared with ``PIVOTS`` members, salted over as many tasks
as the group has blocks.  Pivots that share a linked member are one part, and
the members of the largest such part need no comparison with each other.  Only
the rest is compared, block by block, with everything, so a group of near
copies costs its size, and only members that no pivot of the main part is like
cost more.

5. Connected components of the confirmed links (iterative, checkpointed; no
   link comes to the driver).

Defined cases: a null or empty text, or one without words, has no shingles and
is linked with nothing; fewer words than a shingle make one shingle of all;
a row without an id is linked with nothing and has a null component; rows that
repeat an id are judged each; ties need no rule, as a component's id is its
smallest; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, small_batches
from .pretokens import Cache

COORDINATES = 64
#: Greatest probability that a pair exactly at the threshold is no candidate; pairs above it fail more rarely.
MISS = 1 / 5000
#: Rows, and bytes of text, that one side of a task holds.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Members of a large group that all others are compared with first.
PIVOTS = 4
SKETCH = 1 << 14

_STEP = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=8)
def _hashes(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the coordinates."""
    rng = np.random.Generator(np.random.PCG64(20240601))
    mul = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mul, rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)


def miss(percent: int, coordinates: int, matches: int) -> float:
    """Probability that a pair of similarity ``percent`` agrees in fewer than ``matches`` coordinates."""
    p = percent / 100
    return sum(comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k) for k in range(matches))


@lru_cache(maxsize=128)
def matching(percent: int) -> tuple[int, int]:
    """Coordinates, and the most matches that can be asked for with a miss of at most ``MISS``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    coordinates = COORDINATES
    if miss(percent, coordinates, 1) > MISS:
        coordinates = ceil(log(MISS) / log1p(-percent / 100))
    matches = 1
    while matches < coordinates and miss(percent, coordinates, matches + 1) <= MISS:
        matches += 1
    return coordinates, matches


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z are lower-cased, words are split at ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.hash = Cache(xxhash.xxh64_intdigest, 200_000)

    def __call__(self, text: str | None) -> np.ndarray:
        w = text.encode().lower().split() if text else []
        if not w:
            return np.zeros(0, np.uint64)
        self.hash.trim()
        h = np.fromiter(map(self.hash.__getitem__, w), np.uint64, len(w))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _STEP + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, n_bytes`` (about; of the text), ``digest, sig`` (the coordinates as 32-bit integers; null without shingles).  No shuffle."""
    small_batches(docs.sparkSession, 256)
    coordinates, _ = matching(percent)

    def run(batches):
        shingles = Shingles(words)
        for b in batches:
            texts = b.column(1).to_pylist()
            sets = [shingles(t) for t in texts]
            n = np.array([len(s) for s in sets], np.int64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig: list[bytes | None] = [None] * len(sets)
            has = np.flatnonzero(n)
            if len(has):
                x = np.concatenate([sets[k] for k in has])
                starts = np.cumsum(n[has]) - n[has]
                rows = np.stack([np.minimum.reduceat((x * m + a) >> np.uint64(32), starts) for m, a in zip(*_hashes(coordinates), strict=True)], 1).astype("<u4")
                for k, r in zip(has.tolist(), rows, strict=True):
                    sig[k] = r.tobytes()
            size = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), size, pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "n_bytes", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, n_bytes long, digest binary, sig binary")


def _keys(batch_sigs) -> np.ndarray:
    """A 64-bit key of every coordinate and value: one row a signature."""
    s = np.frombuffer(b"".join(batch_sigs), "<u4").reshape(len(batch_sigs), -1).astype(np.uint64)
    # The coordinate has 8 bits below the value, and its higher bits (more than 256 coordinates) lie above it.
    k = np.arange(s.shape[1], dtype=np.uint64)
    return _mix((s << np.uint64(8)) + (k & np.uint64(255)) + ((k >> np.uint64(8)) << np.uint64(40)))


def _sketch(reps: DataFrame) -> np.ndarray:
    """Counts of all keys over all classes, in SKETCH counters."""

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((_keys(b.column(0).to_pylist()) % np.uint64(SKETCH)).ravel().astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(SKETCH, np.int64)
    for r in reps.select("sig").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _postings(reps: DataFrame, sketch: np.ndarray, prefix: int) -> DataFrame:
    """``grp, rep``: each class under its ``prefix`` rarest keys."""
    shared = reps.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        count = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = _keys(b.column(1).to_pylist())
            order = np.lexsort((keys, count[(keys % np.uint64(SKETCH)).astype(np.int64)]), axis=1)[:, :prefix]
            rep = np.repeat(b.column(0).to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(keys, order, 1).ravel().view(np.int64)), pa.array(rep)], names=["grp", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "grp long, rep long")


class _Forest:
    """Union-find over 0..n-1 by labels; keeps the edges that connected something."""

    def __init__(self, n: int, joined: np.ndarray | None = None):
        """joined: which rows are one part already."""
        self.label = np.arange(n)
        self.size = np.ones(n, np.int64)
        self.edges: list[tuple[int, int]] = []
        if joined is not None and joined.any():
            self.size[joined] = 0
            self.label[joined] = joined.argmax()
            self.size[joined.argmax()] = joined.sum()

    def connect_all(self, agrees, allowed=None) -> list[tuple[int, int]]:
        """``agrees(x)``: which of all agree with x.  Those outside the largest part are compared with all; links into it are found from their other end.

        The largest part may be overtaken, so a row that was left out is looked at again until every row outside the last largest part has been compared.
        """
        n = len(self.label)
        left = np.arange(n)
        while len(left):
            skipped = []
            for x in left.tolist():
                if x and self.label[x] == self.size.argmax():
                    skipped.append(x)
                else:
                    self._join(x, np.flatnonzero(agrees(x) & (True if allowed is None else allowed(x))))
            left = np.array(skipped, np.int64)
            if (self.label[left] == self.size.argmax()).all():
                break
        return self.edges

    def _join(self, x: int, others: np.ndarray) -> None:
        """Connects x with one member of each part among ``others``."""
        others = others[self.label[others] != self.label[x]]
        if len(others):
            _, first = np.unique(self.label[others], return_index=True)
            parts = self.label[others[first]]
            big = max([*parts.tolist(), int(self.label[x])], key=lambda a: self.size[a])
            mine = self.label[x]
            self.edges += [(x, o) for o in others[first].tolist()]
            for a in {*parts.tolist(), int(mine)} - {int(big)}:
                self.label[self.label == a] = big
                self.size[big] += self.size[a]
                self.size[a] = 0


def _groups(batches, columns: int):
    """Lists of columns, one group of equal first column at a time; rows come sorted by it."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = t.column(0).to_numpy()
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = [0, *cuts.tolist()]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            yield t.slice(a, z - a)
        held = t.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held


def _bits(payload: list[bytes], matches: int):
    """``agrees`` of coordinate bytes.

    A coordinate's lowest byte stands for it: agreement is never missed, and chance adds a quarter of one match.
    """
    sig = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
    return lambda x: (sig == sig[x]).sum(1) >= matches


def _full_sets(payload: list[str], shingles: Shingles, percent: int):
    """``agrees`` of whole texts, by inverted lists of their shingles."""
    n = len(payload)
    sets = [shingles(x) for x in payload]
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def agrees(x):
        lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        both = np.bincount(owner[at], minlength=n)
        return 100 * both >= percent * (size + size[x] - both)

    return agrees


def _compare(tasks: DataFrame, likeness) -> DataFrame:
    """``a, b``: a spanning forest of the links inside each task of ``task, rep, payload, side, cross, joined``.

    Where ``cross`` holds, only rows of different sides are compared; ``joined`` rows are connected already.
    """

    def run(batches):
        make = likeness()
        for t in _groups(batches, 6):
            n = t.num_rows
            if n < 2:
                continue
            rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            across = t.column("cross")[0].as_py() and not (side == side[0]).all()
            forest = _Forest(n, t.column("joined").to_numpy() if across else None)
            edges = forest.connect_all(make(t.column("payload").to_pylist()), (lambda x, side=side: side != side[x]) if across else None)
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(rep[e[:, 0]]), pa.array(rep[e[:, 1]])], names=["a", "b"])

    return tasks.select("task", "rep", "payload", "side", "cross", "joined").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _near_pivots(members: DataFrame, likeness) -> DataFrame:
    """``grp, rep, near`` (the pivots that the member is like) of every member of a large group."""
    picked = members.groupBy("grp", "blocks").agg(*[F.min_by(F.struct("rep", "payload"), F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    pivots = picked.select("grp", "blocks", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("p"))
    # A copy of the pivots for every salt: as many rows as the group has blocks.
    sent = pivots.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.col("p.rep").alias("rep"), F.col("p.payload").alias("payload"), F.lit(True).alias("pivot"))
    own = members.select("grp", F.pmod(F.xxhash64("rep", F.lit("salt")), F.col("blocks")).cast("int").alias("salt"), "rep", "payload", F.lit(False).alias("pivot"))

    def run(batches):
        make = likeness()
        for t in _groups(batches, 5):
            pivot, rep = t.column("pivot").to_numpy(), t.column("rep").to_numpy()
            agrees = make(t.column("payload").to_pylist())
            near: list[list[int]] = [[] for _ in rep]
            for x in np.flatnonzero(pivot).tolist():
                for k in np.flatnonzero(agrees(x) & ~pivot).tolist():
                    near[k].append(int(rep[x]))
            own = np.flatnonzero(~pivot)
            yield pa.RecordBatch.from_arrays([t.column("grp").take(pa.array(own)).combine_chunks(), pa.array(rep[own]), pa.array([sorted(near[k]) for k in own.tolist()], pa.list_(pa.int64()))], names=["grp", "rep", "near"])

    both = sent.unionByName(own).withColumn("task", F.xxhash64("grp", "salt"))
    return both.select("task", "grp", "rep", "payload", "pivot").repartition("task").sortWithinPartitions("task").mapInArrow(run, "grp long, rep long, near array<long>")


def _main_part(near: DataFrame) -> DataFrame:
    """``grp, main``: the pivots of the part that holds most members.  At most 2 ** PIVOTS rows a group are gathered."""

    def run(batches):
        for b in batches:
            out = []
            for seen in b.column(1).to_pylist():
                parts: list[tuple[set[int], int]] = []
                for s in seen:
                    pivots, n = set(s["near"]), s["n"]
                    for p in [p for p in parts if p[0] & pivots]:
                        parts.remove(p)
                        pivots, n = pivots | p[0], n + p[1]
                    parts.append((pivots, n))
                out.append(sorted(max(parts, key=lambda p: (p[1], sorted(p[0])))[0]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["grp", "main"])

    kinds = near.where(F.size("near") > 0).groupBy("grp", "near").agg(F.count("*").alias("n"))
    return kinds.groupBy("grp").agg(F.collect_list(F.struct("near", "n")).alias("seen")).mapInArrow(run, "grp long, main array<long>")


def _forest(members: DataFrame, sizes: DataFrame, likeness, long_payload: bool) -> DataFrame:
    """``a, b``: spanning forests of the links within each group of ``members(grp, rep, payload)``; ``sizes(grp, blocks)`` names the groups of two or more."""
    sizes = cut(sizes)
    known = members.join(sizes, "grp")
    split = bool(sizes.where("blocks > 1").head(1))
    if split:
        known = cut(known)  # read several times
    plain = known.where("blocks = 1").select(F.col("grp").alias("task"), "rep", "payload", F.lit(0).alias("side"), F.lit(False).alias("cross"), F.lit(False).alias("joined"))
    found = _compare(plain, likeness)
    if not split:
        return found
    large = known.where("blocks > 1")
    near = cut(_near_pivots(large, likeness))
    stars = near.select(F.col("rep").alias("a"), F.explode("near").alias("b"))
    told = near.join(_main_part(near), "grp", "left").select("grp", "rep", F.coalesce(F.arrays_overlap("near", "main"), F.lit(False)).alias("joined"))
    placed = large.join(told, ["grp", "rep"])
    rest = placed.where("not joined")
    count = F.ceil(F.count("*") / BLOCK)
    if long_payload:
        count = F.greatest(count, F.ceil(F.sum(F.length("payload")) / BLOCK_BYTES))
    left = rest.groupBy("grp").agg(count.cast("int").alias("rests"))
    # Sides 0 .. rests - 1 hold the rest; the blocks of the joined members follow.
    placed = placed.join(left, "grp")
    h = F.xxhash64("rep", F.lit("block"))
    side = F.when(F.col("joined"), F.col("rests") + F.pmod(h, F.col("blocks"))).otherwise(F.pmod(h, F.col("rests"))).cast("int")
    placed = placed.withColumn("side", side)
    # Joined members meet the rest only; each block of the rest meets itself, the others and all joined ones.
    last = F.when(F.col("joined"), F.col("rests") - 1).otherwise(F.col("rests") + F.col("blocks") - 1)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    met = met.withColumn("task", F.xxhash64("grp", F.least("side", "other"), F.greatest("side", "other"))).withColumn("cross", F.lit(True))
    return found.unionByName(stars).unionByName(_compare(met, likeness))


def links(docs: DataFrame, sigs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes (``digest, rep, sig, n_bytes``) and a spanning forest of the confirmed links between them."""
    usable = sigs.where("doc_id is not null and n_shingles > 0")
    reps = cut(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.min_by("n_bytes", "doc_id").alias("n_bytes")))
    coordinates, matches = matching(percent)
    posted = _postings(reps, _sketch(reps), coordinates - matches + 1)
    sizes = posted.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    lowest = F.expr(f"aggregate(sequence(0, {coordinates - 1}), cast('' as binary), (x, k) -> x || substring(sig, 4 * k + 1, 1))")
    # The coordinates join last, so that lists of one class are gone by then.
    listed = posted.join(sizes.select("grp"), "grp").join(reps.select("rep", lowest.alias("payload")), "rep")
    forest = components(_forest(listed, sizes, lambda: lambda payload: _bits(payload, matches), False))
    grouped = cut(forest.select("node", "component").union(forest.select("component", "component")).distinct().toDF("rep", "grp"))
    bytes_of = grouped.join(reps.groupBy("rep").agg(F.max("n_bytes").alias("n_bytes")), "rep")
    sizes = bytes_of.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").alias("payload")).join(grouped, "rep")

    def by_sets():
        shingles = Shingles(words)
        return lambda payload: _full_sets(payload, shingles, percent)

    return reps, _forest(texts, sizes, by_sets, True)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``.  Links: 100 * intersection >= ``percent`` * union of the shingle sets."""
    docs = docs.select("doc_id", "text")
    sigs = cut(signatures(docs, words, percent))
    reps, edges = links(docs, sigs, words, percent)
    found = components(edges).toDF("rep", "component_id")
    of_class = reps.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", mine.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of near duplicates stays: that of the smallest id.

    Of rows that repeat an id one stays; rows without an id all stay.
    """
    kept = near_duplicates(docs, words, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))
