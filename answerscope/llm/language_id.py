"""Language identification by multilingual mixture inference.

Each language has a smoothed model of character trigrams.  A document is a
sequence of words, each drawn from one of the languages it is written in;
expectation-maximisation over the words' trigram likelihoods estimates the
languages' proportions.  The set of languages is then selected by penalised
likelihood: of the sets of the 1, 2, ... strongest languages, each fitted anew,
the one with the least Bayesian information criterion is taken.  The prediction
is its strongest language, the score that language's proportion.

Expectation-maximisation stops when no proportion of a document moves by more
than ``TOLERANCE``, at the latest after ``ROUNDS`` rounds: proportions of texts in
two close languages may then still be some hundredths off, which changes neither
their order nor, as the tests compare, the selected sets.

``keep_known`` also asks whether a text is in any learned language at all.
Proportions cannot tell, as they are shared out among the learned languages;
the mean log-likelihood of a text's trigrams can.  A language's own texts have
about the mean of its counts, a text of unseen trigrams the log-probability of
an unseen one, and the floor is three quarters of the way to the latter.  Only
words of letters count (numbers, keys and addresses are in no language); a text
without any is not judged by this.

Fit: trigram counts over at most about ``max_labelled`` labelled rows of each
language (a documented bound; a hash of the id chooses), kept in ``BUCKETS``
slots a language, so the model's size is fixed.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when no row is labelled; a null or empty language is not
learned from; repeated rows are independent; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches
from .pretokens import Cache

BUCKETS = 1 << 16
UNKNOWN = "und"
ROUNDS, TOLERANCE = 12, 1e-3


def _slots(data: np.ndarray) -> np.ndarray:
    """The slot of each byte trigram of ``data``."""
    d = data.astype(np.uint32)
    return ((d[:-2] | d[1:-1] << 8 | d[2:] << 16) * np.uint32(2654435761)) >> np.uint32(16)


class Model:
    """Log-probabilities of trigram slots by language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        seen = max(1, int((counts.sum(0) > 0).sum()))
        total = counts.sum(1, keepdims=True)
        log = np.log((counts + smooth) / (total + smooth * 2 * seen))
        self.log = log.T.astype(np.float32)  # slot, language
        #: Of each language: the least mean log-likelihood of a trigram in a text that may be in it.
        self.floor = 0.25 * (counts * log).sum(1) / np.maximum(total[:, 0], 1) + 0.75 * np.log(smooth / (total[:, 0] + smooth * 2 * seen))

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word, spaces around it included, by language."""
        raw = [f" {w} ".encode() for w in words]
        n = np.array([len(r) - 2 for r in raw])
        slots = _slots(np.frombuffer(b"".join(raw), np.uint8))
        keep = np.ones(len(slots), bool)
        ends = np.cumsum(n + 2)[:-1]
        keep[ends - 2] = keep[ends - 1] = False  # trigrams that run into the next word
        own = np.cumsum(n) - n
        return np.add.reduceat(self.log[slots[keep]], own, axis=0)


def of_letters(word: str) -> bool:
    """Four of five characters or more, marks at the ends aside."""
    inner = word.strip(".,;:!?\"'()")
    return bool(inner) and 5 * sum(map(str.isalpha, inner)) >= 4 * len(inner)


class Words:
    """word -> row of a growing table of log-likelihoods; emptied past ``limit`` words."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.new: list[str] = []
        self.table = np.zeros((0, len(self.model.langs)), np.float32)
        self.trigrams = np.zeros(0, np.int64)  # of each word of the table; 0 of one that is not of letters
        self.ids = Cache(self._add, 1 << 62)

    def _add(self, word: str) -> int:
        self.new.append(word)
        return len(self.ids)

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all words, and the number of words of each text."""
        if len(self.ids) > self.limit:
            self.clear()
        n = np.array([len(t) for t in texts], np.int64)
        x = np.fromiter((i for t in texts for i in map(self.ids.__getitem__, t)), np.int64, int(n.sum()))
        if self.new:
            self.table = np.concatenate((self.table, self.model.of_words(self.new)))
            self.trigrams = np.concatenate((self.trigrams, [len(w.encode()) * of_letters(w) for w in self.new]))
            self.new = []
        return x, n


def _expect(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, theta: np.ndarray, rounds: int, tol: float = TOLERANCE) -> np.ndarray:
    """Proportions by expectation-maximisation; documents that have settled take no part in later rounds."""
    theta = theta.copy()
    live = np.arange(len(n))
    for _ in range(rounds):
        w = theta[doc] * p
        w /= w.sum(1, keepdims=True)
        new = np.add.reduceat(w, starts, axis=0) / n[:, None]
        moved = np.abs(new - theta[live]).max(1)
        theta[live] = new
        keep = moved > tol
        if not keep.any():
            break
        if not keep.all():
            rows = np.repeat(keep, n)
            p, doc = p[rows], doc[rows]
            live, n = live[keep], n[keep]
            starts = np.cumsum(n) - n
    return theta


def infer(like: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of ``n`` > 0 words with log-likelihoods ``like``: the selected proportions, and the number of selected languages."""
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    top = like.max(1, keepdims=True)
    p = np.exp(np.maximum(like - top, -60.0))
    k = like.shape[1]
    theta = _expect(p, doc, starts, n, np.full((len(n), k), 1.0 / k), rounds)
    order = np.argsort(-theta, axis=1, kind="stable")
    # One language: the best total likelihood; then ever larger sets, fitted anew, while a document still has a candidate.
    single = np.add.reduceat(like.astype(np.float64), starts, axis=0)
    pick = single.argmax(1)
    best = np.zeros_like(theta)
    best[np.arange(len(n)), pick] = 1.0
    criterion = -2 * single[np.arange(len(n)), pick]
    size = np.ones(len(n), np.int64)
    floor = np.add.reduceat(top[:, 0].astype(np.float64), starts)
    for m in range(2, k + 1):
        # A further language of under one word's weight can't pay for its parameter.
        may = theta[np.arange(len(n)), order[:, m - 1]] * n >= 1.0
        if not may.any():
            break
        rows = np.repeat(may, n)
        nn = n[may]
        ss = np.cumsum(nn) - nn
        dd = np.repeat(np.arange(len(nn)), nn)
        start = theta[may].copy()
        np.put_along_axis(start, order[may][:, m:], 0.0, axis=1)
        start = np.maximum(start, 0) / start.sum(1, keepdims=True)
        th = _expect(p[rows], dd, ss, nn, start, rounds)
        fit = np.add.reduceat(np.log(np.maximum((th[dd] * p[rows]).sum(1), 1e-300)).astype(np.float64), ss) + floor[may]
        c = -2 * fit + (m - 1) * np.log(np.maximum(nn, 2))
        better = c < criterion[may]
        at = np.flatnonzero(may)[better]
        best[at], criterion[at], size[at] = th[better], c[better], m
    return best, size


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text and any(map(str.isalpha, text)) else []


def _count(batches, langs: dict[str, int]):
    counts = np.zeros((len(langs), BUCKETS), np.int64)
    for b in batches:
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = np.frombuffer((" " + " ".join(t.lower().split()) + " ").encode(), np.uint8)
            if len(data) > 2:
                counts[langs[lang]] += np.bincount(_slots(data), minlength=BUCKETS)
    lang, slot = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(counts[lang, slot])], names=["lang", "slot", "n"])


def fit(docs: DataFrame, learn_from: Column, max_labelled: int = 3000) -> Model | None:
    """``learn_from``: a condition on ``doc_id`` that rows to learn from must meet."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & (F.col("lang") != "") & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull() & learn_from)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    langs = {x: k for k, x in enumerate(sorted(sizes))}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_labelled / n))])
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(unit < F.element_at(share, F.col("lang"))).select("text", "lang").mapInArrow(lambda b: _count(b, langs), "lang int, slot int, n long")
    got = rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages times BUCKETS rows at most
    counts = np.zeros((len(langs), BUCKETS))
    counts[got["lang"], got["slot"]] = got["n"]
    return Model(list(langs), counts)


def in_some_language(words: Words, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the mean log-likelihood of the trigrams reaches a language's floor, for documents of ``n`` > 0 words with the table rows ``x``."""
    starts = np.cumsum(n) - n
    trigrams = words.trigrams[x]
    like = np.add.reduceat(words.table[x] * (trigrams > 0)[:, None].astype(np.float64), starts, axis=0)
    total = np.add.reduceat(trigrams, starts)
    return (like >= words.model.floor * total[:, None]).any(1)  # holds where nothing counts


def keep_known(docs: DataFrame, model: Model | None, min_score: float = 0.34) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language: not ``und``, likely enough in one of them, and that one's proportion at least ``min_score``.  No shuffle.

    Without a model nothing is known of any language, and every row stays.
    """
    if model is None:
        return docs
    small_batches(docs.sparkSession, 256)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        words = Words(shared.value)
        for b in batches:
            x, n = words.rows([words_of(t) for t in b.column(at).to_pylist()])
            has = n > 0
            good = np.zeros(len(n), bool)
            if has.any():
                good[has] = (infer(words.table[x], n[has])[0].max(1) >= min_score) & in_some_language(words, x, n[has])
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, n_langs`` (languages in the selected set) of each row.  No shuffle."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).alias("n_langs"))
    small_batches(docs.sparkSession, 256)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = Words(shared.value)
        langs = np.array([*shared.value.langs, UNKNOWN], object)
        for b in batches:
            x, n = words.rows([words_of(t) for t in b.column(1).to_pylist()])
            has = n > 0
            name, score, size = np.full(len(n), len(langs) - 1), np.zeros(len(n)), np.zeros(len(n), np.int32)
            if has.any():
                theta, sizes = infer(words.table[x], n[has])
                name[has], score[has], size[has] = theta.argmax(1), np.clip(theta.max(1), 0, 1), sizes
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs[name], pa.string()), pa.array(score), pa.array(size)], names=["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_langs int")
