"""Document fingerprints: canonical exact digests.

The canonical form of a text is its NFKC normalisation, case-folded (and
normalised again, as folding can undo it), with every run of white space folded
to one space and none at the ends.  A fingerprint is the 128-bit xxh3 digest of
the canonical form; equal texts have equal fingerprints, and texts that differ
in case, white space or compatible characters do too.

Equal digests form buckets, and bytes are compared inside them: the least and
the greatest form of a bucket combine before the shuffle, and only buckets of
several rows send their forms at all.  Where they differ, the forms of the
bucket are told apart and numbered, and the fingerprint is ``<digest>-<number>``.
So different forms never share a fingerprint.  ``fingerprints`` treats the
edited texts as further members of the buckets; ``group_copies`` returns the
groups of equal fingerprints.

``likeness`` of two fingerprints is 1.0 if they are equal, else 0.0: an exact
digest knows no more.

``with_next`` pairs each document with the next one in descending id order (the
first after the last): ids are cut into ranges, each range is sorted on its
own, and the first document of each range is also sent to the range before it.
Only ids are sampled for the cuts; no task sees more than its range.

Defined cases: a null text is empty; null ids come last in the order; rows that
repeat an id are ordered by their text and stay in one range; a single row is
its own next; an empty table gives no rows; ids that are not whole numbers are
an error; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, parts, small_batches


def canonical(text: str) -> bytes:
    t = text if text.isascii() else unicodedata.normalize("NFKC", text)
    t = t.casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return " ".join(t.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` (rounded down) replaced by as much of the start of ``following``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _cuts(docs: DataFrame, ranges: int) -> list[int]:
    """Descending ids at which ranges end, from approximate quantiles of the ids alone."""
    if ranges < 2:
        return []
    q = docs.where("doc_id is not null").select("doc_id").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))
    return sorted({int(x) for x in q}, reverse=True)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, text, place`` in range-sorted order, ``last`` marking rows that only stand for the start of the following range.

    Rows of one ``range`` are in one partition, sorted as they follow each other.
    """
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be a whole number")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = _cuts(docs, ranges or 2 * parts(docs.sparkSession))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.array(cuts[::-1], np.int64))

    @F.pandas_udf("int")
    def range_of(i):
        # Range 0 holds the largest ids; a null id is after all.
        at = np.searchsorted(shared.value, i.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series((len(shared.value) - at + i.isna().to_numpy()).astype(np.int32))

    ids = docs.select("doc_id").withColumn("range", range_of("doc_id")).groupBy("range").agg(F.max("doc_id").alias("first"), F.count("*").alias("n"))
    starts = sorted((r["range"], r["first"]) for r in ids.collect())  # a row a range
    if not starts:
        return docs.withColumn("range", F.lit(0)).withColumn("last", F.lit(False))
    # Where the first document of each range is wanted: at the end of the range before, the very first one at the end of the last.
    to = [(starts[k][1], starts[k - 1][0]) for k in range(len(starts))]
    heads = spark.createDataFrame(to, "head long, range int")
    found = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
    # Of rows that repeat the first id, the one that sorts first.
    one = found.groupBy("range").agg(F.min(F.struct("text", "doc_id")).alias("s")).select(F.col("s.doc_id"), F.col("s.text"), "range", F.lit(True).alias("last"))
    every = docs.withColumn("range", range_of("doc_id")).withColumn("last", F.lit(False)).unionByName(one)
    # By range, not by hash: each range gets a partition of its own whatever their number.
    return every.repartitionByRange(len(starts), "range").sortWithinPartitions("range", "last", F.desc_nulls_last("doc_id"), "text")


#: Rows up to which a table of digests is broadcast (about 40 MB); a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, of which the rows are stored, as a broadcast side if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _raw(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


_PAIRS = pa.schema({"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "digest": pa.string(), "edited_digest": pa.string(), "edited_same": pa.bool_(), "next_same": pa.bool_(), "raw": pa.binary(), "next_id": pa.int64(), "next_raw": pa.binary()})


def _pairs(docs: DataFrame, ranges: int | None, digest) -> DataFrame:
    """A row a document, no texts: the digests of its form and of its edited text's, whether the forms are equal (bytes, here at hand), and what names both texts."""

    def run(batches):
        held = None  # the row before, which waits for its next one: (range, id, text, canonical form)
        for b in batches:
            out: list[list] = [[] for _ in _PAIRS.names]
            for i, text, rng, last in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                form = canonical(text)
                if held is not None and held[0] == rng:
                    _, hid, htext, hform = held
                    new = edited(htext, text)
                    eform = canonical(new)
                    row = (hid, len(htext), hashlib.sha256(new.encode()).hexdigest(), digest(hform), digest(eform), hform == eform, hform == form, _raw(htext), i, _raw(text))
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                held = None if last else (rng, i, text, form)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _PAIRS, strict=True)], schema=_PAIRS)

    kinds = "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, edited_same boolean, next_same boolean, raw binary, next_id long, next_raw binary"
    return with_next(docs, ranges).mapInArrow(run, kinds)


def _forms(texts: DataFrame, digest) -> DataFrame:
    """``doc_id, raw, digest, form`` of ``texts(doc_id, text)``."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            forms = [canonical(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_raw, texts), pa.binary()), pa.array(map(digest, forms), pa.string()), pa.array(forms, pa.binary())], names=["doc_id", "raw", "digest", "form"])

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, raw binary, digest string, form binary")


def _edited_forms(docs: DataFrame, wanted: DataFrame, digest) -> DataFrame:
    """``doc_id, raw, next_id, next_raw, digest, form`` of the edited texts that ``wanted`` names."""

    def named(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((_raw(t or "") for t in b.column(1).to_pylist()), pa.binary()), b.column(1)], names=["i", "r", "t"])

    def run(batches):
        for b in batches:
            forms = [canonical(edited(t or "", u or "")) for t, u in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(map(digest, forms), pa.string()), pa.array(forms, pa.binary())], names=["doc_id", "raw", "next_id", "next_raw", "digest", "form"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(named, "i long, r binary, t string")
    key = ["doc_id", "raw", "next_id", "next_raw"]
    # Rows of one id and text are one here.
    first = texts.join(_small(wanted), texts["i"].eqNullSafe(wanted["doc_id"]) & (texts["r"] == wanted["raw"])).groupBy(*key).agg(F.first("t").alias("text"))
    mine = cut(first)
    both = texts.join(_small(mine), texts["i"].eqNullSafe(mine["next_id"]) & (texts["r"] == mine["next_raw"])).groupBy(*key, "text").agg(F.first("t").alias("following"))
    return both.select(*key, "text", "following").mapInArrow(run, "doc_id long, raw binary, next_id long, next_raw binary, digest string, form binary")


def _told(forms: DataFrame) -> DataFrame | None:
    """``digest, form, k`` of the buckets in which forms differ; None where there is none."""
    clash = cut(forms.groupBy("digest").agg(F.min("form").alias("a"), F.max("form").alias("z")).where("a <> z").select("digest"))
    if not clash.head(1):
        return None
    told = forms.join(_small(clash), "digest").select("digest", "form").distinct()
    return told.withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("form")))


def _name(digest: str, k: str):
    """A digest that several forms share gets the number of its form."""
    return F.when(F.col(k).isNull(), F.col(digest)).otherwise(F.concat_ws("-", F.col(digest), F.col(k)))


def fingerprints(docs: DataFrame, ranges: int | None = None, digest=digest) -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and, of the rows with this fingerprint, ``group_id`` (smallest id) and ``copies``."""
    small_batches(docs.sparkSession)
    rows = cut(_pairs(docs, ranges, digest))
    changed = rows.where("not edited_same").select(F.col("edited_digest").alias("digest"), "doc_id", "raw", "next_id", "next_raw")
    repeated = cut(rows.select("digest").unionByName(changed.select("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    own = _forms(docs, digest).join(_small(repeated), "digest")
    wanted = cut(changed.join(_small(repeated), "digest").drop("digest").distinct())
    other = _edited_forms(docs, wanted, digest)
    told = _told(own.select("digest", "form").unionByName(other.select("digest", "form")))
    if told is None:
        out = rows.withColumn("fingerprint", F.col("digest")).withColumn("edited_fingerprint", F.col("edited_digest"))
    else:
        of_own = own.join(told, ["digest", "form"]).select(F.col("doc_id").alias("i"), F.col("raw").alias("r"), F.col("k").alias("own_k")).distinct()
        key = ("doc_id", "raw", "next_id", "next_raw")
        of_other = other.join(told, ["digest", "form"]).select(*[F.col(c).alias(f"o_{c}") for c in key], F.col("k").alias("other_k"))
        out = rows.join(of_own, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("raw") == F.col("r")), "left")
        same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in key]
        out = out.join(of_other, same[0] & same[1] & same[2] & same[3], "left")
        out = out.withColumn("fingerprint", _name("digest", "own_k"))
        out = out.withColumn("edited_fingerprint", F.when(F.col("edited_same"), F.col("fingerprint")).otherwise(_name("edited_digest", "other_k")))
    groups = out.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    out = out.join(groups, "fingerprint")
    # Forms were compared byte by byte where both texts were at hand, which is what equal fingerprints say.
    near = [F.col(c).cast("double").alias(n) for c, n in (("edited_same", "near_edited"), ("next_same", "near_next"))]
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, "group_id", "copies")


def group_copies(docs: DataFrame, digest=digest) -> DataFrame:
    """Per row: ``doc_id, fingerprint, group_id`` (smallest id of the rows with the same canonical form), ``copies``."""
    small_batches(docs.sparkSession)
    forms = _forms(docs, digest)
    repeated = cut(forms.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    told = _told(forms.join(_small(repeated), "digest"))
    if told is None:
        every = forms.select("doc_id", F.col("digest").alias("fingerprint"))
    else:
        every = forms.join(told, ["digest", "form"], "left").select("doc_id", _name("digest", "k").alias("fingerprint"))
    groups = every.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    return every.join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")
