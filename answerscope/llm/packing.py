"""Best-fit packing of token pieces into sequences, with swap-based local search.

Only lengths matter for packing, and there are at most ``capacity`` of them, so
the plan is made over the histogram of lengths: a *class* is a bin content (a
multiset of lengths) and how many bins have it.  ``best_fit`` puts the copies of
each length, the longest first, into the fullest
contents that take them.  Local search then works on underfull classes: between
two bins it tries to move a piece, to exchange one for one, or two for one, and
applies the exchange that most increases the sum of squared fills (all bins of
the two classes that can, do it together), until no exchange helps between any
two bins or the number of bins is the least that the total length allows.  The
partners of a bin are found by sets of the lengths that each can give and take,
held as bits.

The search over the best fit of all lengths has as many contents as there are
lengths, about, whatever the number of pieces, and moves all bins of a content together.  Where it ends
above the least number of bins, a finer search follows, and the packing of fewer bins is
taken: all counts are divided by a scale that leaves about ``LEVEL`` pieces,
these are packed by best fit in both orders and searched, every bin is used as often as the scale says, and
what the division left over is the next level, down to a scale of one.  That is
a logarithmic number of searches of a fixed size.

Pieces then take their places: within a length they are numbered by salted
groups of about ``ROWS_PER_SALT`` rows (no length, however frequent, is numbered
in one task), and a number is turned into (bin, offset) by a table of at most a
few classes a length.  What comes to the driver and is broadcast is one number a
length and one a group: 10,000 for 10 billion pieces.

Defined cases: a null or empty text is its end token only; only documents
longer than ``capacity`` are cut, and then the first piece is the short one;
repeated rows are packed once each, as are rows without an id; pieces of equal
length are interchangeable, and which of them goes where follows from their ids;
an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches

Content = tuple[int, ...]


#: Pieces that one level of the search packs.
LEVEL = 4096
#: Rows of one length that are numbered in one group.
ROWS_PER_SALT = 1 << 20


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if it has one, else one from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizer:
    """The ids that a byte-level BPE tokenizer file gives to whole texts, its added tokens included."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] and spec["normalizer"] is None
        if not plain or made != sorted(made) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is no plain byte-level BPE whose merges are in the order of their ids")
        byte = _byte_alphabet()
        ranks = {bytes(map(byte.__getitem__, t)): k for t, k in vocab.items() if t not in added}
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._all = set(added)
        self._encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> list[int]:
        if self._added and self._added.search(text):
            return self._encoding.encode(text, allowed_special=self._all)
        return self._encoding.encode_ordinary(text)


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One a worker process."""
    return Tokenizer(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, by the tokenizer file at ``path``.  No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc = tokenizer(path, pattern)
        for b in batches:
            src, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*enc.encode(t or ""), end_id], "<u4")
                n = len(ids)
                first = n % capacity or capacity
                at = 0
                for p, to in enumerate(range(first, n + 1, capacity)):
                    src.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[at:to].tobytes()))
                    at = to
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(src, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int, mixed: bool = False) -> Counter[Content]:
    """Contents and how many bins have them: copies of each length go to the fullest contents with room for one more.

    The longest come first, or if ``mixed`` the lengths come in a mixed but fixed order (by the fractional parts of multiples of the golden ratio).
    """
    bins: Counter[Content] = Counter()
    by_room: dict[int, dict[Content, None]] = {}
    rooms: list[int] = []  # sorted rooms that some content has

    def add(c: Content, n: int) -> None:
        if n and not bins[c]:
            room = capacity - sum(c)
            if room not in by_room:
                by_room[room] = {}
                bisect.insort(rooms, room)
            by_room[room][c] = None
        bins[c] += n

    for x in sorted(histogram, key=lambda x: (x * 0x9E3779B1 % (1 << 32) if mixed else -x, x)):
        left = histogram[x]
        while left and (k := bisect.bisect_left(rooms, x)) < len(rooms):
            room = rooms[k]
            c = next(iter(by_room[room]))
            times = min(left, bins[c])
            left -= times
            bins[c] -= times
            if not bins[c]:
                del bins[c], by_room[room][c]
                if not by_room[room]:
                    del by_room[room], rooms[k]
            add(tuple(sorted((*c, x), reverse=True)), times)
        each = capacity // x
        add((x,) * each, left // each)
        if left % each:
            add((x,) * (left % each), 1)
    return +bins


def _sums(b: Content) -> dict[int, Content]:
    """The sums of one or two pieces of a bin, and pieces that make them."""
    n = Counter(b)
    u = sorted(n)
    out: dict[int, Content] = {x + y: (x, y) for k, x in enumerate(u) for y in u[k:] if x != y or n[x] > 1}
    return out | {x: (x,) for x in u}


def _better(a: Content, b: Content, capacity: int) -> tuple[Content, Content] | None:
    """The move, one-for-one or two-for-one exchange into ``a`` from ``b``, which is no fuller, that most increases the sum of squared fills."""
    room, gives = capacity - sum(a), _sums(b)
    sums = sorted(gives)
    best, most = None, 0
    for x in (0, *sorted(set(a))):
        # The more a fuller bin gains, the better.
        k = bisect.bisect_right(sums, x + room) - 1
        if k >= 0 and sums[k] - x > most:
            best, most = (x, sums[k]), sums[k] - x
    if best is None:
        return None
    ca, cb = Counter(a), Counter(b)
    x, y = Counter([best[0]] if best[0] else []), Counter(gives[best[1]])
    pick = lambda c: tuple(sorted(c.elements(), reverse=True))
    return pick(ca - x + y), pick(cb - y + x)


class _Settled:
    """Contents of which no two have an exchange that helps; what each can give and take is a row of bits, one a sum of lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.words = capacity, capacity // 64 + 1
        self.at: dict[Content, int] = {}
        self.of: list[Content | None] = []
        self.free: list[int] = []
        self.fill = np.zeros(0, np.int64)
        self.gives = self.takes = np.zeros((0, self.words), np.uint64)

    def bits(self, c: Content) -> tuple[np.ndarray, np.ndarray]:
        room, gives, takes = self.capacity - sum(c), 0, 0
        for y in _sums(c):
            gives |= 1 << y
        for x in (0, *set(c)):
            takes |= ((1 << room) - 1) << (x + 1)
        row = lambda v: np.frombuffer(v.to_bytes(self.words * 8, "little"), "<u8")
        return row(gives), row(takes)

    def partner(self, c: Content, gives: np.ndarray, takes: np.ndarray) -> tuple[Content, Content] | None:
        """Taker and giver of an exchange of ``c`` with a settled content: with the fullest that takes from it, else the emptiest that gives."""
        f = sum(c)
        k = np.flatnonzero((self.takes & gives).any(1) & (self.fill >= f))
        if len(k):
            return self.of[k[self.fill[k].argmax()]], c
        k = np.flatnonzero((self.gives & takes).any(1) & (self.fill <= f))
        if len(k):
            return c, self.of[k[self.fill[k].argmin()]]
        return None

    def add(self, c: Content, gives: np.ndarray, takes: np.ndarray) -> None:
        if not self.free:
            n = max(64, len(self.of))
            self.free = list(range(len(self.of) + n - 1, len(self.of) - 1, -1))
            self.of += [None] * n
            self.fill = np.append(self.fill, np.zeros(n, np.int64))
            none = np.zeros((n, self.words), np.uint64)
            self.gives, self.takes = np.concatenate([self.gives, none]), np.concatenate([self.takes, none])
        k = self.free.pop()
        self.at[c], self.of[k], self.fill[k], self.gives[k], self.takes[k] = k, c, sum(c), gives, takes

    def remove(self, c: Content) -> None:
        k = self.at.pop(c, None)
        if k is not None:
            self.free.append(k)
            self.of[k], self.gives[k], self.takes[k] = None, 0, 0


def local_search(bins: Counter[Content], capacity: int) -> Counter[Content]:
    """Exchanges between underfull bins until none between any two of them helps, or there are as few bins as the total length allows."""
    bins = Counter({c: n for c, n in bins.items() if n})
    least = -(-sum(sum(c) * n for c, n in bins.items()) // capacity)
    count = bins.total()
    settled = _Settled(capacity)
    todo = [(sum(c), c) for c in bins if sum(c) < capacity]
    heapq.heapify(todo)
    while todo and count > least:
        f, c = heapq.heappop(todo)
        if not bins[c] or c in settled.at:
            continue
        gives, takes = settled.bits(c)
        pair = (c, c) if bins[c] > 1 and (gives & takes).any() else settled.partner(c, gives, takes)
        if pair is None:
            settled.add(c, gives, takes)
            continue
        a, b = pair
        new = _better(a, b, capacity)
        times = bins[a] // 2 if a == b else min(bins[a], bins[b])
        for x in pair:
            bins[x] -= times
        for x in new:
            if x:
                bins[x] += times
            else:
                count -= times
        for x in {*pair, *new}:
            # A content with more bins than before may now exchange with itself; one without bins is gone.
            if not bins[x] or x in new:
                settled.remove(x)
            if bins[x] and sum(x) < capacity and x not in settled.at:
                heapq.heappush(todo, (sum(x), x))
    return +bins


def in_levels(histogram: dict[int, int], capacity: int) -> Counter[Content]:
    """Searches ever finer levels of the histogram; each has fewer than ``2 * LEVEL`` pieces or about that."""
    out: Counter[Content] = Counter()
    left = {x: n for x, n in histogram.items() if n}
    while left:
        scale = min(max(1, sum(left.values()) // LEVEL), max(left.values()))
        level = {x: n // scale for x, n in left.items() if n >= scale}
        found = min((local_search(best_fit(level, capacity, mixed), capacity) for mixed in (True, False)), key=Counter.total)
        for content, n in found.items():
            out[content] += n * scale
        left = {x: n - scale * level.get(x, 0) for x, n in left.items() if n > scale * level.get(x, 0)}
    return out


def plan(histogram: dict[int, int], capacity: int) -> Counter[Content]:
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    best = local_search(best_fit(histogram, capacity), capacity)
    if best.total() > -(-sum(x * n for x, n in histogram.items()) // capacity):
        best = min(best, in_levels(histogram, capacity), key=Counter.total)
    return best


def _slots(bins: Counter[Content]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first number): length, first number, first sequence, copies in a bin, and their offsets' place in the last array."""
    rows, offsets, first = [], [], 0
    used: Counter[int] = Counter()
    for content, n in sorted(bins.items(), reverse=True):
        at: dict[int, list[int]] = {}
        o = 0
        for x in content:
            at.setdefault(x, []).append(o)
            o += x
        for x, places in at.items():
            rows.append((x, used[x], first, len(places), len(offsets)))
            offsets += places
            used[x] += len(places) * n
        first += n
    rows.sort()
    return (*np.array(rows, np.int64).reshape(-1, 5).T, np.array(offsets, np.int64))


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """``found`` (from ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    found = cut(found)  # numbers only; tokenizing is not repeated
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    slots = _slots(plan(counts, capacity))
    salts = {x: -(-n // ROWS_PER_SALT) for x, n in counts.items()}
    several = [F.lit(v) for x, n in salts.items() if n > 1 for v in (x, n)]
    of = F.coalesce(F.create_map(*several)[F.col("length").cast("int")], F.lit(1)) if several else F.lit(1)
    keyed = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), of).cast("int"))
    # Where the numbers of each group of each length start; groups of a length are next to each other.
    first = np.zeros(capacity + 2, np.int64)
    first[1:] = np.cumsum([salts.get(x, 0) for x in range(capacity + 1)])
    start = np.zeros(int(first[-1]), np.int64)
    if several:
        for r in keyed.groupBy("length", "salt").count().collect():  # a row a group
            start[first[r["length"]] + r["salt"]] = r["count"]
        for x, n in salts.items():
            own = start[first[x] : first[x] + n]
            own[:] = np.cumsum(own) - own
    shared = spark.sparkContext.broadcast((slots, first, start))

    def run(batches):
        (length, number, sequence, copies, at, offsets), first, start = shared.value
        span = max(1, int(number.max(initial=0)) + 1)
        for b in batches:
            x = b.column("length").to_numpy()
            n = start[first[x] + b.column("salt").to_numpy()] + b.column("rank").to_numpy() - 1
            k = np.searchsorted(length * span + number, x * span + np.minimum(n, span - 1), side="right") - 1
            own = n - number[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[k] + own // copies[k]), pa.array(offsets[at[k] + own % copies[k]])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    from pyspark.sql import Window

    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")).cast("long"))
    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
