"""Ranked lexical search with a bit-sliced index of integer impacts.

The score of a document for a query sums ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``
over the query's distinct terms, with ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``m = 10 + (90 * n * N) div L``: N documents hold a term, L counts all terms, n those of the document.

1. ``forward``: one pass over the texts keeps every document's length and how often
   it holds each term of the vocabulary (the terms that are asked for).
2. ``statistics``: N, L and the number of documents of each term, over all rows.
3. ``index``: documents are taken in blocks of up to ``BLOCK``, ascending by id.  For
   every term of a block, slice b is a bitmap of the documents whose impact has bit
   b set.  Words of a bitmap that are zero in all slices are left out, the rest
   is compressed.  A row a block and term; every document is in it.
4. ``search``: a block's slices of a query's terms are added by bitwise carry
   arithmetic (a carry-save adder a term, one ripple at the end), so a few operations add
   the impacts of 64 documents.  The best k are found from the most significant
   slice down: documents of the remaining candidates that have the bit set go
   ahead while they number no more than k.  Equal scores are cut by ascending
   id.  Tasks keep k documents a query, and Spark ranks those.

The scores are exact, so recall is 1.  Queries go in batches of about
``TERMS_AT_ONCE`` terms, each of which is one pass over the documents: a batch's queries and vocabulary are
all that is sent to the tasks or comes to the driver.

Defined cases: a null or empty text has no terms and is never returned; a row
without an id counts in N, L and df and is never returned; rows that repeat an
id are ranked each; a query without terms, without an id, or whose terms no
document holds gives no rows; of several queries with one id the terms are united;
an empty table of either kind gives no rows; extra columns are not read.  Texts
of any length are read whole.
"""

from __future__ import annotations

from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, small_batches

#: Documents of a block, at most 65536 words of 64.
BLOCK = 8192
#: Terms of the queries that are searched together (with repeats between queries).
TERMS_AT_ONCE = 400_000

#: What separates terms: all ASCII characters but digits and letters.  A-Z are lower-cased.
_TABLE = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_LANE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def queries_of(items: DataFrame) -> DataFrame:
    """``item_id, term`` of every query, once each."""

    def run(batches):
        for b in batches:
            found = [(i, t) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])

    read = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return read.mapInArrow(run, "item_id long, term binary").distinct()


def forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n`` (terms with repeats), ``ids`` (places in the vocabulary) and ``tfs`` (occurrences), both as 32-bit numbers, of every row.  No shuffle."""
    small_batches(docs.sparkSession, 256)
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches):
        place = shared.value.get
        for b in batches:
            n, ids, tfs = [], [], []
            for text in b.column(1).to_pylist():
                words = terms(text)
                held, tf = np.unique(np.array([k for k in map(place, words) if k is not None], "<u4"), return_counts=True)
                n.append(len(words))
                ids.append(held.tobytes())
                tfs.append(tf.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "ids", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary, tfs binary")


def statistics(counted: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L, and the weight of each of the ``size`` terms (0 where no document holds it), over all rows of ``forward``."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            if b.num_rows:
                df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    total = counted.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    documents, length = total["docs"], total["n"]
    weights = np.zeros(size, np.int64)
    for r in counted.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")).collect():
        weights[r["term"]] = floor(1000 * log((2 * documents + 2) / (2 * r["df"] + 1)))
    return documents, length, weights


def _sliced(doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
    """``term, slices, places, bits`` of each term of a block; ``doc`` is a document's place in the block."""
    order = np.lexsort((doc, term))
    doc, term, impact = doc[order], term[order], impact[order]
    word = doc // 64
    lane = _LANE[doc % 64]
    # The postings of one term and word stand together and become one column of words.
    new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (word[1:] != word[:-1])]))
    depth = int(impact.max()).bit_length()
    bits = np.stack([np.bitwise_or.reduceat(np.where((impact >> b) & 1, lane, np.uint64(0)), new) for b in range(depth)])
    column_term, column_word = term[new], word[new].astype("<u2")
    bounds = np.concatenate([[0], np.flatnonzero(column_term[1:] != column_term[:-1]) + 1, [len(new)]])
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = bits[:, a:z]
        used = int(np.flatnonzero(mine.any(1)).max()) + 1
        yield int(column_term[a]), used, column_word[a:z].tobytes(), squeeze(np.ascontiguousarray(mine[:used]).astype("<u8").tobytes())


def index(counted: DataFrame, documents: int, length: int, weights: np.ndarray) -> DataFrame:
    """``block, term, slices, places, bits``: the bit slices of each term of each block; the row whose term is -1 has the block's ids.  No shuffle."""
    shared = counted.sparkSession.sparkContext.broadcast(weights)
    small_batches(counted.sparkSession, 512)
    block = BLOCK

    def built(rows: pa.Table, number: int):
        weight = shared.value
        rows = rows.sort_by("doc_id")
        ids = [np.frombuffer(x, "<u4") for x in rows.column("ids").to_pylist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        term = np.concatenate(ids).astype(np.int64)
        tf = np.frombuffer(b"".join(rows.column("tfs").to_pylist()), "<u4").astype(np.int64)
        m = 10 + (90 * rows.column("n").to_numpy() * documents) // length
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))
        doc = np.repeat(np.arange(len(ids)), sizes)
        some = impact > 0
        found = [(-1, 0, None, rows.column("doc_id").to_numpy().astype("<i8").tobytes())]
        if some.any():
            found += _sliced(doc[some], term[some], impact[some])
        for k in range(0, len(found), 512):
            t, s, p, b = zip(*found[k : k + 512], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(t), pa.int64()), pa.array(t, pa.int64()), pa.array(s, pa.int32()), pa.array(p, pa.binary()), pa.array(b, pa.binary())], names=["block", "term", "slices", "places", "bits"])

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            while b.num_rows:
                piece, b = b.slice(0, block - n), b.slice(block - n)
                held.append(piece)
                n += piece.num_rows
                if n == block:
                    yield from built(pa.Table.from_batches(held), number)
                    number, held, n = number + 1, [], 0
        if n:
            yield from built(pa.Table.from_batches(held), number)

    # Documents without a term that is asked for score nothing for any query of the batch.
    return counted.where("doc_id is not null and length(ids) > 0").mapInArrow(run, "block long, term long, slices int, places binary, bits binary")


class Block:
    """The slices of one block: adds terms, finds the best documents."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.words = -(-len(ids) // 64)
        self.slices: dict[int, tuple[int, bytes, bytes]] = {}
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        if term not in self.held:
            n, places, bits = self.slices[term]
            at = np.frombuffer(places, "<u2").astype(np.int64)
            self.held[term] = at, np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), "<u8").reshape(n, len(at))
        return self.held[term]

    def added(self, asked: list[int]) -> np.ndarray:
        """Slices of the sums over ``asked``, least significant first: carry-save adders, then one ripple."""
        found = [self.of(t) for t in asked if t in self.slices]
        if not found:
            return np.zeros((0, self.words), np.uint64)
        depth = sum((1 << len(b)) - 1 for _, b in found).bit_length()
        sums = np.zeros((2, depth + 1, self.words), np.uint64)  # the sum is sums[0] + sums[1]; the last row is only carried into
        for at, bits in found:
            whole = len(at) == self.words
            s, c = (sums[0], sums[1]) if whole else (sums[0][:, at], sums[1][:, at])
            x = np.zeros((depth, len(at)), np.uint64)
            x[: len(bits)] = bits
            half = s[:depth] ^ c[:depth]
            carry = (s[:depth] & c[:depth]) | (half & x)
            s[:depth] = half ^ x
            c[1:], c[0] = carry, 0
            if not whole:
                sums[0][:, at], sums[1][:, at] = s, c
        out, carry = np.empty((depth, self.words), np.uint64), np.zeros(self.words, np.uint64)
        for b in range(depth):
            s, c = sums[0, b], sums[1, b]
            half = s ^ c
            out[b], carry = half ^ carry, (s & c) | (half & carry)
        return out

    def best(self, asked: list[int], k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best documents of a score above 0, those of smaller ids where scores are equal."""
        sums = self.added(asked)
        count = lambda x: int(np.bitwise_count(x).sum())
        maybe = np.bitwise_or.reduce(sums, 0) if len(sums) else np.zeros(self.words, np.uint64)
        sure, ahead = np.zeros(self.words, np.uint64), 0
        if count(maybe) > k:
            for row in sums[::-1]:
                high = maybe & row
                n = count(high)
                if ahead + n > k:
                    maybe = high
                else:
                    sure, ahead, maybe = sure | high, ahead + n, maybe & ~row
                    if ahead == k:
                        break
        at = self._places(sure)
        at = np.concatenate([at, self._places(maybe)[: k - len(at)]])
        score = sum((((sums[b][at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b for b in range(len(sums))), np.zeros(len(at), np.int64))
        return list(zip(score.tolist(), self.ids[at].tolist(), strict=True))

    @staticmethod
    def _places(bitmap: np.ndarray) -> np.ndarray:
        word, lane = np.nonzero((bitmap[:, None] & _LANE) != 0)
        return 64 * word + lane


def _blocks(batches):
    """Blocks, one at a time; rows come sorted by block and term, the ids first."""
    number, cur = None, None
    for b in batches:
        for block, term, n, places, bits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if block != number:
                if cur is not None:
                    yield cur
                number, cur = block, Block(np.frombuffer(bits, "<i8"))
            else:
                cur.slices[term] = n, places, bits
    if cur is not None:
        yield cur


def best(built: DataFrame, asked: dict[int, list[int]], k: int) -> DataFrame:
    """``item_id, doc_id, score``: of each task the k best documents of each of the queries ``asked`` (ids to places in the vocabulary)."""
    shared = built.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        found: dict[int, list[tuple[int, int]]] = {}
        for block in _blocks(batches):
            for item, wanted in shared.value.items():
                found[item] = sorted([*found.get(item, []), *block.best(wanted, k)], key=lambda x: (-x[0], x[1]))[:k]
        rows = [(i, d, s) for i, x in found.items() for s, d in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    sorted_blocks = built.repartition("block").sortWithinPartitions("block", "term")
    return sorted_blocks.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of all ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    asked = cut(queries_of(items))
    batches = max(1, ceil(asked.count() / TERMS_AT_ONCE))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for batch in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == batch).collect()
        vocabulary = sorted({bytes(r["term"]) for r in mine})
        place = {t: p for p, t in enumerate(vocabulary)}
        wanted: dict[int, list[int]] = {}
        for r in mine:
            wanted.setdefault(r["item_id"], []).append(place[bytes(r["term"])])
        counted = cut(forward(docs, vocabulary))
        documents, length, weights = statistics(counted, len(vocabulary))
        if length:
            out = out.unionByName(best(cut(index(counted, documents, length, weights)), wanted, k))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
