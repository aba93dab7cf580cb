"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
labelled texts, score each whole text by the difference of their
log-likelihoods divided by the number of words.  The lower orders:
a class backs off from its bigrams to its own continuation counts, and these
to continuation counts that both classes share, so an expression that is rare
in either class has the same smoothed probability in both and says nothing.

Departures from the plain method, and why: with the closed-form discounts of
modified Kneser-Ney smoothing (they are the first of ``SETTINGS``) the
length-normalised difference alone does not tell the given texts apart, as a
few words are toxic among hundreds of rare ones (area under the curve 0.76 to
0.88, recall 0.24 at most).  So ``SETTINGS`` also has larger discounts, which
leave all but frequent expressions to the shared counts, and the calibration
sees a second length-normalised sum, over the expressions with a ratio beyond
``telling``.  Held rows choose the setting.

Fit: all labelled rows that may be learned from, whatever their number.  Four of five of them give counts; the
rest, unseen by the models, calibrate the difference to a probability.  The class with more words has its discounts
scaled up by as much, so that neither has the larger model.  The labelled texts are joined and written once, and
every count, and every step of the calibration, is a Spark aggregate over them; only the model, as Arrow columns, and sums
of a few numbers a class and setting come to the driver.  The vocabulary holds every word, and every beginning of rarer ones, seen ``min_count``
times; a setting's sums over bigrams come from all of them, by a join of the held texts' bigrams with the counts.  Of the chosen setting's bigrams those that
the discount leaves something count: up to ``broadcast`` of them go to the tasks with the model, more stay a table that the texts' bigrams are joined with.

Defined cases: a null text scores as an empty one; an empty text gets the
score of the average text; a document labelled more than once counts as toxic
if any of its labels does; null labels and null ids are not learned from; without
labels of both classes every score is 0; extra columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import Files
from ._common import cut, shared_dir, small_batches
from .pretokens import Cache

#: Marks that are not part of a word's ends.
MARKS = ".,;:!?\"'()[]{}<>*#$%&|…-–—“”„«»¡¿_~^`/\\+=@"
UNK, START = 0, 1
#: Letters of a word's beginning that name its class.
STEM = 4
#: (discount of bigram counts, discount of continuation counts, ratio beyond which a word tells of a class by itself)
#: to choose from; None: the closed-form discounts.  A large discount leaves all but frequent expressions to the shared counts.
SETTINGS = ((None, None, 1.5), (2.0, 0.5, 1.5), (20.0, 2.0, 1.5), (1000.0, 2.0, 1.5), (1000.0, 5.0, 1.5), (1000.0, 10.0, 1.2), (1000.0, 20.0, 1.0), (1000.0, 40.0, 0.8))


def word_of(chunk: str) -> str:
    return chunk.strip(MARKS)


def stem_of(word: str) -> str:
    """The class that stands for the rare words of a common beginning."""
    return "\0" + word[:STEM]


def unit_of(words: dict[str, int], chunk: str) -> int:
    """A frequent word stands for itself, a rare one for its stem's class, anything else for the unknown."""
    word = word_of(chunk)
    k = words.get(word)
    return words.get(stem_of(word), UNK) if k is None else k


#: Different words, or bigrams with their repeats, that a task gathers before it hands on their counts.
GATHERED = 2_000_000


def _sum_counts(batches, words: dict[str, int] | None):
    """Word counts of a task (``words`` None), or class-wise counts of bigrams of known words; a task hands them on whenever it has gathered many."""
    from collections import Counter

    if words is None:
        counts: Counter = Counter()

        def told():
            by_word: Counter = Counter()
            for chunk, n in counts.items():
                word = word_of(chunk)
                by_word[word] += n
                by_word[stem_of(word)] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(by_word), pa.string()), pa.array(list(by_word.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(1).to_pylist():
                counts.update(t.lower().split())
            if len(counts) > GATHERED:
                yield told()
        yield told()
        return
    ids = Cache(lambda c: unit_of(words, c), 200_000)
    size = len(words) + 2
    parts: list[np.ndarray] = []

    def found():
        key, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts.clear()
        toxic = key % 2 == 1
        return pa.RecordBatch.from_arrays([pa.array(key // 2), pa.array(np.where(toxic, 0, n)), pa.array(np.where(toxic, n, 0))], names=["pair", "o", "t"])

    held = 0
    for b in batches:
        ids.trim()
        for t, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.array([START, *map(ids.__getitem__, t.lower().split())], np.int64)
            parts.append((x[:-1] * size + x[1:]) * 2 + toxic)
            held += len(x)
        if held > GATHERED:
            yield found()
            held = 0
    yield found()


def closed_form(n: np.ndarray) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more of modified Kneser-Ney smoothing, from how many expressions have the counts 1 to 4."""
    if n.min() < 1:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))], 0, [0, 1, 2, 3])


def _held(counts: np.ndarray, discount: float | None, n: np.ndarray) -> np.ndarray:
    """What is taken from each count and given to the lower order."""
    return np.minimum(counts, discount) if discount is not None else closed_form(n)[np.minimum(counts, 3).astype(np.int64)]


class Model:
    """Log-likelihood ratios (toxic to ordinary) of bigrams; all arrays are bounded by the fit's parameters."""

    def __init__(self, words: dict[str, int], pair: np.ndarray, counts: np.ndarray, types: np.ndarray, of: np.ndarray, seen: np.ndarray, discount: float | None = None, lower_discount: float | None = None, telling: float = 1.5, scale: tuple[float, float] = (1.0, 1.0), left_over: np.ndarray | None = None):
        """pair: sorted left * size + right of the bigrams, counts: of each by class (ordinary, toxic); types: contexts that each unit follows, of: bigrams from each unit, seen: how many bigrams have the counts 1 to 4, by class; scale: what given discounts are multiplied by, by class; left_over: what the discounts leave of all bigrams from each unit, by class, if ``pair`` does not hold them all."""
        self.words, self.size, self.telling = words, len(words) + 2, telling
        self.seen, self.discounts, self.of = seen, [discount and discount * c for c in scale], np.maximum(of, 1).astype(np.float32)
        self.bigrams: str | None = None  # where bigrams too many for the model are
        shared = types.sum(1) + 0.5
        shared = shared / shared.sum()
        if left_over is None:
            left_over = np.stack([np.bincount(pair // self.size, weights=own, minlength=self.size) for own in self.own(counts)], 1)
        weights, lowers = [], []
        for c in (0, 1):
            total = max(types[:, c].sum(), 1.0)
            taken = _held(types[:, c], lower_discount and lower_discount * scale[c], np.array([(types[:, c] == k).sum() for k in (1, 2, 3, 4)]))
            lower = (types[:, c] - taken) / total + (taken.sum() / total if types[:, c].any() else 1.0) * shared
            weight = np.where(of[:, c] > 0, 1 - left_over[:, c] / np.maximum(of[:, c], 1), 1.0)
            weights.append(np.maximum(weight, 1e-6))
            lowers.append(lower)
        self.weight, self.lower = np.stack(weights, 1).astype(np.float32), np.stack(lowers, 1).astype(np.float32)
        self.left_back = (np.log(weights[1]) - np.log(weights[0])).astype(np.float32)
        self.right_back = (np.log(lowers[1]) - np.log(lowers[0])).astype(np.float32)
        self.weights = np.zeros(5)
        self.take(pair, counts)

    def own(self, counts: np.ndarray) -> list[np.ndarray]:
        """What the discount leaves of counts, by class."""
        return [counts[:, c] - _held(counts[:, c], self.discounts[c], self.seen[:, c]) for c in (0, 1)]

    def ratios(self, pair: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the bigrams have something left, and the ratios of these; any other has the ratio of the lower order."""
        own = self.own(counts)
        kept = np.flatnonzero((own[0] > 0) | (own[1] > 0))
        left, right = pair[kept] // self.size, pair[kept] % self.size
        p = [own[c][kept] / self.of[left, c] + self.weight[left, c].astype(np.float64) * self.lower[right, c] for c in (0, 1)]
        return kept, (np.log(p[1]) - np.log(p[0])).astype(np.float32)

    def take(self, pair: np.ndarray, counts: np.ndarray) -> None:
        """The bigrams that the model itself holds, sorted."""
        kept, self.ratio = self.ratios(pair, counts)
        self.pair = pair[kept]

    def back(self, pair: np.ndarray) -> np.ndarray:
        return self.left_back[pair // self.size] + self.right_back[pair % self.size]

    def sums(self, texts: list[str], ids: Cache) -> np.ndarray:
        """Of each text: the summed log-likelihood ratio, its part from telling words (ratio beyond ``telling``), the number of words."""
        rows = [[START, *map(ids.__getitem__, t.lower().split())] for t in texts]
        n = np.array([len(r) for r in rows], np.int64)
        x = np.fromiter((i for r in rows for i in r), np.int64, int(n.sum()))
        key = x[:-1] * self.size + x[1:]
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        back = self.left_back[x[:-1]] + self.right_back[x[1:]]
        r = np.where(self.pair[at] == key, self.ratio[at], back) if len(self.pair) else back
        ends = np.cumsum(n)
        out = []
        for v in (r, np.where(np.abs(r) > self.telling, r, 0)):
            total = np.concatenate(([0.0], np.cumsum(np.concatenate((v, [0.0])), dtype=np.float64)))
            out.append(total[ends - 1] - total[ends - n])
        return np.stack([*out, n - 1], 1)

    @staticmethod
    def features(sums: np.ndarray) -> np.ndarray:
        """A constant; each length-normalised difference, and the same times the square root of the length, its precision."""
        n = np.maximum(sums[:, 2], 1)
        mean, telling = sums[:, 0] / n, sums[:, 1] / n
        return np.stack([np.ones(len(n)), 10 * mean, mean * np.sqrt(n), 10 * telling, telling * np.sqrt(n)], 1)

    def newton(self, sums: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """What rows add to the logistic regression at the present weights: the curvature, the slope and the loss, as one row of numbers."""
        x, p = self.features(sums), self.score(sums)
        loss = np.logaddexp(0, np.where(toxic, -1, 1) * (x @ self.weights)).sum()
        return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (toxic - p), [loss]])

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(sums) @ self.weights, -30, 30)))


def _given(labels: DataFrame, learn_from) -> DataFrame:
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)


def labelled(labels: DataFrame, learn_from) -> DataFrame:
    """``doc_id, toxic, held``: all labelled ids that may be learned from, each once."""
    own = _given(labels, learn_from).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return own.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0)


#: Spark's runtime filter keeps texts without a label out of the shuffle where the labels are too many to broadcast.
FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g", "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000", "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432"}


def _store(docs: DataFrame, labels: DataFrame, learn_from, path: str) -> DataFrame:
    """``doc_id, text, toxic, held`` of the labelled texts, written to ``path``."""
    spark = docs.sparkSession
    before = {k: spark.conf.get(k, None) for k in FILTERED}
    for k, v in FILTERED.items():
        spark.conf.set(k, v)
    try:
        known = docs.where(learn_from & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # The filter needs a side without a grouping; both joins have the same key, so texts are shuffled once.
        known = known.join(_given(labels, learn_from).select("doc_id").hint("merge"), "doc_id", "left_semi")
        known.join(labelled(labels, learn_from).hint("merge"), "doc_id").select("doc_id", "text", "toxic", "held").write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(path)


def fit(docs: DataFrame, labels: DataFrame, learn_from, min_count: int = 20, settings: tuple[tuple[float | None, float | None, float], ...] = SETTINGS, broadcast: int = 2_000_000) -> Model | None:
    """``learn_from``: a condition on ``doc_id`` that labelled rows must meet.

    Words seen less than ``min_count`` times are counted by their stem.  Nothing else is pooled or left out; ``broadcast`` only
    tells from how many bigrams on scoring joins them instead of taking them along.
    """
    small_batches(docs.sparkSession)
    files = Files(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/toxicity-{uuid.uuid4().hex}")
    model = None
    try:
        model = _fit(_store(docs, labels, learn_from, f"{files.root}/texts"), files.root, min_count, settings, broadcast)
        return model
    finally:
        # Bigrams that scoring joins stay in the shared folder, like a checkpoint.
        for name in ("texts", "bigrams") if model is not None and model.bigrams else ("",):
            files.delete(name)


def _fit(known: DataFrame, folder: str, min_count: int, settings, broadcast: int) -> Model | None:
    spark = known.sparkSession
    train = known.where("not held")
    counts = train.mapInArrow(lambda b: _sum_counts(b, None), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # What comes to the driver comes as Arrow columns: as rows, each of them would be a Python object of many times its size.
    top = counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "word").select("word").toArrow().column(0).to_pylist()
    if not top or known.agg(F.count_distinct("toxic")).head()[0] < 2:
        return None
    words = {w: k + 2 for k, w in enumerate(top)}
    pairs = train.mapInArrow(lambda b: _sum_counts(b, words), "pair long, o long, t long")
    # One row a distinct bigram; columns in files take a fraction of a checkpoint's rows.
    pairs.groupBy("pair").agg(F.sum("o").alias("o"), F.sum("t").alias("t")).write.parquet(f"{folder}/bigrams")
    both = spark.read.parquet(f"{folder}/bigrams")
    size = len(words) + 2
    types = by_unit(both.groupBy(F.expr(f"pair % {size}").alias("k")).agg(F.count_if(F.col("o") > 0).alias("o"), F.count_if(F.col("t") > 0).alias("t")), size)
    of = by_unit(both.groupBy(F.expr(f"pair div {size}").alias("k")).agg(F.sum("o").alias("o"), F.sum("t").alias("t")), size)
    seen = np.zeros((4, 2))
    for c, name in enumerate("ot"):
        for r in both.where(F.col(name).between(1, 4)).groupBy(F.col(name).alias("k")).count().collect():
            seen[r["k"] - 1, c] = r["count"]
    total = of.sum(0)
    scale = tuple(total / total.min()) if total.min() > 0 else (1.0, 1.0)
    none = np.zeros(0, np.int64), np.zeros((0, 2))
    left = left_over(both, size, seen, sorted({d[0] for d in settings}, key=str), scale)
    models = [Model(words, *none, types, of, seen, *d, scale, left[d[0]]) for d in settings]
    # The setting is the one of a few whose calibrated scores fit the held rows best; all are tried in one pass.
    held = known.where("held").select("doc_id", "text", "toxic")
    best = models[0]
    if held.agg(F.count_distinct("toxic")).head()[0] == 2:
        sums = cut(_joined_sums(held, models, both))  # a row of numbers a held text and setting
        best = models[int(np.argmin(calibrate(sums, models)))]
    telling = both.where(" or ".join(_left(n, best.discounts[c], seen[:, c]) + " > 0" for c, n in enumerate("ot")))
    if telling.count() <= broadcast:
        pair, o, t = columns(telling.select("pair", "o", "t"))
        order = np.argsort(pair)
        best.take(pair[order], np.stack([o[order], t[order]], 1).astype(np.float64))
    else:
        best.bigrams = f"{folder}/telling"
        telling.write.parquet(best.bigrams)
    return best


def _left(name: str, discount: float | None, seen: np.ndarray) -> str:
    """What the discount leaves of a column of counts, as ``Model.own`` has it."""
    if discount is not None:
        return f"greatest({name} - {float(discount)!r}D, 0D)"
    closed = ", ".join(f"{float(x)!r}D" for x in closed_form(seen))
    return f"({name} - element_at(array({closed}), cast(least({name}, 3) + 1 as int)))"


def left_over(both: DataFrame, size: int, seen: np.ndarray, discounts: list[float | None], scale: tuple[float, float]) -> dict[float | None, np.ndarray]:
    """Of each discount, what it leaves of the bigrams from each unit, by class."""
    told = [F.sum(F.expr(_left(n, d and d * scale[c], seen[:, c]))).alias(f"{n}{i}") for i, d in enumerate(discounts) for c, n in enumerate("ot")]
    k, *v = columns(both.groupBy(F.expr(f"pair div {size}").alias("k")).agg(*told))
    out = {}
    for i, d in enumerate(discounts):
        out[d] = np.zeros((size, 2))
        out[d][k] = np.stack(v[2 * i : 2 * i + 2], 1)
    return out


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of whole numbers."""
    return [c.to_numpy() for c in df.toArrow().columns]


def by_unit(df: DataFrame, size: int) -> np.ndarray:
    """``o`` and ``t`` at place ``k`` of ``size``, absent as 0."""
    out = np.zeros((size, 2))
    k, o, t = columns(df.select("k", "o", "t"))
    out[k, 0], out[k, 1] = o, t
    return out


def calibrate(sums: DataFrame, models: list[Model]) -> np.ndarray:
    """Logistic regression of all models by Newton's method; the losses.  Each step is one aggregate over ``sums``, the rows of ``_sums``."""
    k = len(models[0].weights)
    width = k * k + k + 1
    shells = [Model.__new__(Model) for _ in models]  # the weights alone go to the tasks

    def run(batches):
        for b in batches:
            of, toxic = b.column(0).to_numpy(), b.column(1).to_numpy() == 1
            rows = np.stack([b.column(c).to_numpy() for c in (2, 3, 4)], 1)
            for m in np.unique(of):
                own = of == m
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([own.sum()], pa.int64()), *[pa.array([v]) for v in shells[m].newton(rows[own], toxic[own])]], names=["model", "rows", *names])

    names = [f"v{i}" for i in range(width)]
    losses = np.zeros(len(models))
    # Of each model: the least penalised loss so far, its weights, and the step to try from there, halved while it leads to a larger loss.
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    still = list(range(len(models)))
    for _ in range(80):
        for shell, m in zip(shells, models, strict=True):
            shell.weights = m.weights
        told = sums.where(F.col("model").isin(still)).select("model", "toxic", "total", "telling", "n").mapInArrow(run, "model int, rows long, " + ", ".join(f"{n} double" for n in names))
        for r in told.groupBy("model").agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in names]).collect():
            v, at, m = np.array([r[n] for n in names]), r["model"], models[r["model"]]
            now = v[-1] + 0.5e-2 * m.weights @ m.weights
            if at not in best or now <= best[at][0] * (1 + 1e-9):
                losses[at] = v[-1] / r["rows"]
                best[at] = now, m.weights, np.linalg.solve(v[: k * k].reshape(k, k) + 1e-2 * np.eye(k), v[k * k : -1] - 1e-2 * m.weights)
            else:
                best[at] = *best[at][:2], best[at][2] / 2
            _, weights, move = best[at]
            # Tasks end in any order, and so do the last digits of a sum.
            m.weights = np.round(weights + move, 10)
            if np.abs(move).max() < 1e-6:
                still.remove(at)
        if not still:
            break
    for at in still:
        models[at].weights = best[at][1]
    return losses


def _sums(df: DataFrame, shared: Broadcast) -> DataFrame:
    """A row a document and model of the broadcast list: the sums and the score."""
    small_batches(df.sparkSession)

    def run(batches):
        models = shared.value
        ids = Cache(lambda c: unit_of(models[0].words, c), 200_000)
        for b in batches:
            ids.trim()
            texts = [t or "" for t in b.column(1).to_pylist()]
            for k, m in enumerate(models):
                sums = m.sums(texts, ids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.full(len(texts), k, np.int32)), *map(pa.array, sums.T), pa.array(m.score(sums))], names=["doc_id", third, "model", "total", "telling", "n", "score"])

    third = df.columns[2]
    kind = df.schema[2].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {df.schema[0].dataType.simpleString()}, {third} {kind}, model int, total double, telling double, n double, score double")


def _joined_sums(df: DataFrame, models: list[Model], bigrams: DataFrame) -> DataFrame:
    """The rows of ``_sums`` (without the score) of models that hold no bigrams: what the lower order says of a text, and what the bigrams it has change of that.

    ``bigrams(pair, o, t)`` may be as many as the corpus has; the different bigrams of the texts are joined with them and only changes go back to the text.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(models)
    third = df.columns[2]
    rows = df.withColumn("row", F.monotonically_increasing_id())

    def had(batches):
        m = shared.value[0]
        ids = Cache(lambda c: unit_of(m.words, c), 200_000)
        for b in batches:
            ids.trim()
            at, keys, times = [], [], []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array([START, *map(ids.__getitem__, (t or "").lower().split())], np.int64)
                key, n = np.unique(x[:-1] * m.size + x[1:], return_counts=True)
                at.append(np.full(len(key), row)), keys.append(key), times.append(n.astype(np.int32))
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (at, keys, times)], names=["row", "pair", "times"])

    def changes(batches):
        for b in batches:
            row, pair, times = (b.column(c).to_numpy() for c in (0, 1, 2))
            counts = np.stack([b.column(c).to_numpy() for c in (3, 4)], 1).astype(np.float64)
            for k, m in enumerate(shared.value):
                kept, ratio = m.ratios(pair, counts)
                back = m.back(pair[kept])
                tell = np.where(np.abs(ratio) > m.telling, ratio, 0) - np.where(np.abs(back) > m.telling, back, 0)
                n = times[kept].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(row[kept]), pa.array(np.full(len(kept), k, np.int32)), pa.array((ratio - back) * n), pa.array(tell * n)], names=["row", "model", "total", "telling"])

    pairs = rows.select("row", "text").mapInArrow(had, "row long, pair long, times int")
    changed = pairs.join(bigrams, "pair").select("row", "pair", "times", "o", "t").mapInArrow(changes, "row long, model int, total double, telling double")
    base = _sums(rows.select("row", "text", F.lit(0).alias("x")), shared).select(F.col("doc_id").alias("row"), "model", "total", "telling", "n")
    both = base.unionByName(changed.groupBy("row", "model").agg(F.sum("total").alias("total"), F.sum("telling").alias("telling")).withColumn("n", F.lit(None).cast("double")))
    sums = both.groupBy("row", "model").agg(*[F.sum(c).alias(c) for c in ("total", "telling")], F.max("n").alias("n"))
    return rows.select("row", "doc_id", third).join(sums, "row").select("doc_id", third, "model", "total", "telling", "n")


def _scored(sums: DataFrame, model: Model) -> DataFrame:
    shell = Model.__new__(Model)  # the weights alone go to the tasks
    shell.weights = model.weights

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shell.score(np.stack([b.column(c).to_numpy() for c in (1, 2, 3)], 1)))], names=["doc_id", "score"])

    return sums.select("doc_id", "total", "telling", "n").mapInArrow(run, f"doc_id {sums.schema['doc_id'].dataType.simpleString()}, score double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: ``doc_id, score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).  No shuffle, unless the model's bigrams are too many to take along."""
    df = docs.select("doc_id", "text", F.lit(0).alias("x"))
    spark = docs.sparkSession
    if model is None:
        out = df.select("doc_id", F.lit(0.0).alias("score"))
    elif model.bigrams is None:
        out = _sums(df, spark.sparkContext.broadcast([model])).select("doc_id", "score")
    else:
        out = _scored(_joined_sums(df, [model], spark.read.parquet(model.bigrams)), model)
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
