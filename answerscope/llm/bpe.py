"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte runs.  Every adjacent pair that the
vocabulary can merge is filed by its rank: one bucket a rank holds the places
of the pairs, and a two-level bitmap marks the ranks whose bucket is not empty,
so the lowest rank is found by two find-first-set steps whatever the length.
A merge does not search the buckets for the pairs it destroys: an entry whose
pair has changed since is skipped when it comes up.  A pre-token of n bytes
costs O(n log n) at worst, which keeps texts without white space cheap.

Defined cases: a null text encodes as an empty one; an empty text has no ids;
equal texts have equal ids; a null id passes through.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import small_batches
from .pretokens import PIECEWISE, Cache, Splitter

_BITS = 256


class RankQueue:
    """Priority queue of (rank, place): the lowest rank first, then the lowest place."""

    def __init__(self, n_ranks: int):
        self.words = [0] * (n_ranks // _BITS + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [place]
            w = rank >> 8
            self.words[w] |= 1 << (rank & 255)
            self.top |= 1 << w
        else:
            heappush(bucket, place)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        rank = (w << 8) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[w] = word
            if not word:
                self.top = top & (top - 1)
        return rank, place


#: Pre-tokens of up to this many bytes are merged together in one queue of arrays; longer ones each in their own queue.
TOGETHER = 64


class Encoder:
    """Encodes and decodes by a table of ranks; each match of ``pattern`` is merged separately.

    A token's id is its rank, so the id of a merged run is the rank that its pair was filed under.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(k) for k in range(len(self.bytes_of))]
        self.n = len(self.bytes_of)
        self.pretokens = Cache(lambda t: self.merge(t.encode()), cache)
        self.splitter = Splitter(self._pieces, cache, pattern in PIECEWISE)
        self.byte_id = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        # Every pair of tokens that makes a token, as left * n + right, in order; and the rank of what it makes.
        found = [(ranks[t[:k]] * self.n + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        found.sort()
        self.pair_key = np.array([x for x, _ in found] + [2**62], np.int64)
        self.pair_rank = np.array([x for _, x in found] + [-1], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token, in a queue of its own."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, get, queue = len(piece), ranks.get, RankQueue(self.n)
        end = list(range(1, n + 1))  # where the run that starts here ends: the next run's start
        before = list(range(-1, n - 1))  # the previous run's start
        pair = [get(piece[i : i + 2]) for i in range(n)]  # rank of this run with the next; None: can't merge, or no run starts here
        pair[n - 1] = None
        for i, r in enumerate(pair):
            if r is not None:
                queue.push(r, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            if pair[i] != rank:
                continue  # stale: one of the two runs has changed
            j = end[i]
            k = end[i] = end[j]
            pair[j] = None
            changed = [i]
            if k < n:
                before[k] = i
            if before[i] >= 0:
                changed.append(before[i])
            for x in changed:
                y = end[x]
                r = get(piece[x : end[y]]) if y < n else None
                if r != pair[x]:
                    pair[x] = r
                    if r is not None:
                        queue.push(r, x)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def merge_together(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many short pre-tokens, in one queue whose buckets hold arrays of places.

        When a rank comes up, each pre-token merges its first pair of that rank;
        further ones stay in the bucket.  So each pre-token goes through its
        merges in the same order as alone, and the cost of a step is shared.
        """
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(data)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = np.cumsum(length) - 1
        owner = np.repeat(np.arange(len(pieces)), length)
        token = self.byte_id[data]
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        after[last] = -1
        before[last - length + 1] = -1
        pair = np.full(size, -1, np.int64)
        pair[:-1] = self._rank(token[:-1], token[1:])
        pair[last] = -1
        words, top, buckets = [0] * (self.n // _BITS + 1), 0, {}
        place = np.flatnonzero(pair >= 0)
        waiting, least = [place], 0  # places that are not in their buckets yet, and the least rank among them
        while True:
            w = (top & -top).bit_length() - 1
            rank = (w << 8) | ((words[w] & -words[w]).bit_length() - 1) if top else self.n
            if waiting and least <= rank:
                place = np.concatenate(waiting)
                r = pair[place]
                order = np.argsort(r, kind="stable")
                place, r = place[order], r[order]
                at = np.flatnonzero(r[1:] != r[:-1]) + 1
                for q, x in zip(r[np.concatenate(([0], at))].tolist() if len(r) else [], np.split(place, at), strict=False):
                    if q < 0:
                        continue  # merged away while it waited
                    buckets.setdefault(q, []).append(x)
                    words[q >> 8] |= 1 << (q & 255)
                    top |= 1 << (q >> 8)
                waiting, least = [], self.n
                continue
            if not top:
                break
            words[w] &= words[w] - 1
            if not words[w]:
                top &= top - 1
            x = buckets.pop(rank)
            i = x[0] if len(x) == 1 else np.concatenate(x)
            i = i[pair[i] == rank]  # the others are stale
            if not len(i):
                continue
            i = np.unique(i)
            mine = owner[i]
            later = np.zeros(len(i), bool)
            later[1:] = mine[1:] == mine[:-1]
            if later.any():
                buckets[rank] = [i[later]]
                words[w] |= 1 << (rank & 255)
                top |= 1 << w
                i = i[~later]
            j = after[i]
            k = after[j]
            token[i], after[i], pair[i], pair[j], after[j] = rank, k, -1, -1, -2
            more = k >= 0
            left = i[more]
            before[k[more]] = left
            pair[left] = self._rank(token[left], token[k[more]])
            h = before[i]
            h = h[h >= 0]
            pair[h] = self._rank(token[h], token[after[h]])
            new = np.concatenate((left, h))
            r = pair[new]
            new = new[r >= 0]
            if len(new):
                waiting.append(new)
                least = min(least, int(pair[new].min()))
        start = after != -2
        ids = token[start].tolist()
        ends = np.cumsum(np.bincount(owner[start], minlength=len(pieces))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _pieces(self, text: str) -> tuple[int, ...]:
        found = self.pattern.findall(text)
        if len(found) == 1:
            return self.pretokens[found[0]]
        return tuple(chain.from_iterable(map(self.pretokens.__getitem__, found)))

    def prepare(self, texts: list[str]) -> None:
        """Merge what ``texts`` need and the caches lack, short pre-tokens together."""
        self.pretokens.trim()
        known, have, split = self.pretokens, self.ranks, self.splitter
        pieces, alone = split.missing(texts)
        found = list(map(self.pattern.findall, map(split.whole, pieces)))
        missing = set(chain.from_iterable(found)).union(*map(self.pattern.findall, alone)).difference(known)
        new, raw = [], []
        for t in missing:
            b = t.encode()
            if (r := have.get(b)) is not None:
                known[t] = (r,)
            elif len(b) <= TOGETHER:
                new.append(t)
                raw.append(b)
        if new:
            known.update(zip(new, self.merge_together(raw), strict=True))
        get = known.__getitem__
        split.cache.update((p, get(f[0]) if len(f) == 1 else tuple(chain.from_iterable(map(get, f)))) for p, f in zip(pieces, found, strict=True))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.splitter.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base-64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process, so that its cache serves all tasks."""
    return Encoder(read_ranks(path), pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` (of the decoded bytes).

    ``path`` is the vocabulary file, installed on every machine.  No shuffle.
    """
    small_batches(docs.sparkSession, 1024)

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            enc.prepare(texts)
            for t in texts:
                ids = enc.encode(t)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(enc.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id and ``ids``, the token ids."""
    small_batches(docs.sparkSession, 1024)

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            enc.prepare(texts)
            ids = [enc.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
