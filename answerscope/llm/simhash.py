"""SimHash near-duplicates: 64-bit fingerprints within a small Hamming distance.

1. Fingerprints: a bit is 1 if it is set in over half of the XXH64 values of the
   text's word shingles, repeats included.  Equal fingerprints are one class
   from here on (a grouping that combines before the shuffle), so any number of
   copies is one row.
2. Blocks: fingerprints that differ in ``radius`` bits or fewer agree in one of
   ``radius + 1`` portions of the bits.  Each class is posted under its value
   of every portion.  A block (equal portion and value) of more than ``BLOCK``
   classes is cut again by the same rule on the bits that are still free, so a
   dense one is refined and not compared as a whole.  Every cut takes a
   share of the free bits, and classes are distinct, so blocks
   become small of themselves: no row is left out and no number is capped.
3. Comparison inside a block is bit-sliced: bit planes are stored vertically, 64
   classes a word.  One plane after the other, the difference of a class from
   64 others is added to carry-save counters (a word of ones, twos, fours ... and
   one of those beyond the radius), so a few bitwise operations advance 64
   distances.  A word whose 64 distances are all beyond the radius is abandoned.
   All small blocks of a batch go through the same vectors.
4. A task sends a spanning forest of the links it finds in each block, never
   all pairs, and ``components`` connects them (iterative, checkpointed; no
   link comes to the driver).

Defined cases: a null or empty text, or one without words, has fingerprint zero
and is linked like any other; fewer words than a shingle make one shingle; a row
without an id has a fingerprint, is linked with nothing and has a null
component; rows that repeat an id are linked each by its own text; ties need no
rule, as a component's id is its smallest; an empty table gives no rows; extra
columns are not read.  Very long texts are read whole, ``AT_ONCE`` shingles at a
time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, small_batches

BITS = 64
SEED = 42
#: Classes that a block may hold before it is cut again.
BLOCK = 4096
#: Shingles whose bits are counted at a time (4 MB of bits).
AT_ONCE = 1 << 16
#: Words of 64 comparisons that are advanced together.
LANES = 1 << 15
#: Planes after which abandoned words are taken out.
STRIDE = 6


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of each bit over the shingles' XXH64 values, as an unsigned number."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    n = min(words, len(w))
    total, ones = len(w) - n + 1, np.zeros(BITS, np.int64)
    for k in range(0, total, AT_ONCE):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[j : j + n]), SEED) for j in range(k, min(k + AT_ONCE, total))), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed number) of every row.  No shuffle."""
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for b in batches:
            bits = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, bits long")


def portions(agreed: int, radius: int) -> list[int]:
    """The bits outside ``agreed`` dealt into radius + 1 parts of near equal size, each with ``agreed``: masks as signed numbers."""
    free = [k for k in range(BITS) if not agreed >> k & 1]
    bounds = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    masks = [agreed | sum(1 << k for k in free[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    return [int(np.uint64(m).astype(np.int64)) for m in masks]


def blocks(classes: DataFrame, radius: int) -> DataFrame:
    """``mask, value, bits``: classes under each block of two to ``BLOCK`` of them; every pair within ``radius`` shares one."""
    masks, cur, done = [0], classes.select(F.lit(0).cast("long").alias("mask"), "bits"), None
    while True:
        # The masks of a level follow from those of the one before, whatever the data.
        under = {m: portions(m & (1 << BITS) - 1, radius) for m in masks}
        children = F.create_map(*[F.lit(x) for pair in under.items() for x in pair])
        posted = cur.select(F.explode(F.element_at(children, F.col("mask"))).alias("mask"), "bits").select("mask", F.col("mask").bitwiseAND(F.col("bits")).alias("value"), "bits")
        if done is not None:
            posted = posted.distinct()  # deep masks may be reached in several ways
        sizes = posted.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        posted = cut(posted.join(sizes, ["mask", "value"]))
        small = posted.where(F.col("n") <= BLOCK).select("mask", "value", "bits")
        done = small if done is None else done.unionByName(small)
        cur = posted.where(F.col("n") > BLOCK).select("mask", "bits")
        masks = sorted({x for child in under.values() for x in child})
        if cur.isEmpty():
            return done


def within(bits: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int):
    """Pairs (row, later row) of rows in the same run that differ in ``radius`` bits or fewer, in portions.

    ``bits`` are unsigned fingerprints; row k lies in the run of rows ``start[k]`` to ``end[k] - 1``.
    """
    n = len(bits)
    size = -(-n // 64)
    padded = np.zeros(size * 64, np.uint64)
    padded[:n] = bits
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    lane = np.uint64(1) << np.arange(64, dtype=np.uint64)
    # planes[b, w] holds bit b of the rows 64 w to 64 w + 63.
    planes = np.stack([((((padded >> np.uint64(b)) & np.uint64(1)) * np.tile(lane, size)).reshape(size, 64)).sum(1, dtype=np.uint64) for b in range(BITS)])
    rows = np.arange(n)
    first, last = (rows + 1) // 64, (end - 1) // 64
    count = np.where(rows + 1 < end, last - first + 1, 0)
    counters = radius.bit_length()
    lo = 0
    while lo < n:
        upto = np.cumsum(count[lo:])
        hi = lo + max(1, int(np.searchsorted(upto, LANES, "right")))
        mine, c = rows[lo:hi], count[lo:hi]
        total = int(c.sum())
        q = np.repeat(mine, c)
        w = np.repeat(first[lo:hi], c) + np.arange(total) - np.repeat(np.cumsum(c) - c, c)
        # Lanes that stand for no later row of the run count as beyond the radius from the start.
        low = np.clip(q + 1 - 64 * w, 0, 64)
        high = np.clip(end[q] - 64 * w, 0, 64)
        ahead = np.concatenate([(np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1), [every]])  # ahead[k]: the k lowest lanes
        beyond = ~(ahead[high] & ~ahead[low])
        sums = np.zeros((counters, total), np.uint64)
        for b in range(BITS):
            carry = planes[b, w] ^ (np.uint64(0) - ((bits[q] >> np.uint64(b)) & np.uint64(1)))
            for k in range(counters):
                sums[k], carry = sums[k] ^ carry, sums[k] & carry
            beyond |= carry
            over, equal = np.zeros(total, np.uint64), np.full(total, every)
            for k in reversed(range(counters)):  # bitwise: is the sum over the radius?
                if radius >> k & 1:
                    equal &= sums[k]
                else:
                    over |= equal & sums[k]
                    equal &= ~sums[k]
            beyond |= over
            if b % STRIDE == STRIDE - 1:
                alive = np.flatnonzero(beyond != every)
                if len(alive) < total:
                    q, w, beyond, sums, total = q[alive], w[alive], beyond[alive], sums[:, alive], len(alive)
                    if not total:
                        break
        hit = np.flatnonzero(beyond != every)
        # A few words at a time: each may stand for 64 pairs.
        for k in range(0, len(hit), LANES // 16):
            h = hit[k : k + LANES // 16]
            x, y = np.nonzero((~beyond[h, None] & lane) != 0)
            yield q[h][x], 64 * w[h][x] + y
        lo = hi


def spanning(n: int, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Of the ``pairs`` (arrays a, b in portions) over rows 0 to n - 1 those that connect something new."""
    label, kept = np.arange(n), []
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            new = x != y
            if not new.any():
                break
            a, b, x, y = a[new], b[new], x[new], y[new]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            one = order[np.unique(high[order], return_index=True)[1]]  # each part hooks on one smaller part
            kept.append((a[one], b[one]))
            parent = np.arange(n)
            parent[high[one]] = low[one]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def links(classes: DataFrame, radius: int) -> DataFrame:
    """``a, b``: a spanning forest of each block's links between distinct ``bits``."""

    def run(batches):
        held = None
        for last, b in _with_end(batches):
            t = b if held is None else pa.concat_tables([held, b])
            keys = np.stack([t.column(c).to_numpy() for c in ("mask", "value")], 1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            # The last block of a batch may go on in the next one.
            upto = t.num_rows if last else int(change[-1]) if len(change) else 0
            if upto:
                bounds = np.concatenate([[0], change[change < upto], [upto]])
                sizes = np.diff(bounds)
                bits = t.column("bits").to_numpy()[:upto]
                a, z = spanning(upto, within(bits.view(np.uint64), np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes), radius))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(bits[a]), pa.array(bits[z])], names=["a", "b"])
            held = t.slice(upto)

    dealt = blocks(classes, radius).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(run, "a long, b long")


def _with_end(batches):
    """(is it the last, table) of the batches that have rows."""
    held = None
    for b in batches:
        if b.num_rows:
            if held is not None:
                yield False, held
            held = pa.Table.from_batches([b])
    if held is not None:
        yield True, held


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id reachable over links)."""
    if radius < 0 or 2**radius > BLOCK:  # a block of radius free bits can't be cut again
        raise ValueError(f"radius must be from 0 to {BLOCK.bit_length() - 1}")
    found = cut(fingerprints(docs, words))
    classes = cut(found.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes, radius)) if radius else None
    named = classes
    if joined is not None:
        # Components are named by a fingerprint first; their id is the smallest of all their classes.
        part = F.coalesce("component", "bits")
        placed = cut(classes.join(joined.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "rep", part.alias("component")))
        named = placed.select("bits", "component").join(placed.groupBy("component").agg(F.min("rep").alias("rep")), "component")
    out = found.join(named.select("bits", "rep"), "bits", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.col("rep"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), mine.alias("component_id"))
