"""Quality rules as a learned decision list (native: DataFrame functions only).

``text_statistics`` derives counts and ratios of every whole text with built-in
functions.  ``learn`` takes the statistics of at most ``max_labelled`` labelled
rows and runs sequential covering over them: one conjunction of thresholds at a
time is grown by information gain on the growing rows, pruned on the pruning
rows and kept while it is precise; the rows it covers are set aside.  ``apply``
turns the ordered list into one conditional expression.

Defined cases: a null text has no words; a null or empty text fails the base
rule; labels that are null are not learned from; when a document is labelled
more than once, the lowest quality counts; without usable labels the list is
empty and only the base rule decides; repeated rows are judged each; an empty
table gives no rows; a text of any length is read whole; extra columns pass
through ``apply``, and one that is named like a result comes back as
``<name>_in``; ``keep`` returns the columns as they are; names starting with
``_q_`` are reserved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import set_aside

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
FEATURES = ("n_words", "mean_word", "symbol_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "line_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(f"_q_{self.feature}")
        return x >= self.threshold if self.at_least else x < self.threshold

    def holds(self, row) -> bool:
        x = row[FEATURES.index(self.feature)]
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A document that meets every condition is rejected."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def holds(self, row) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.conditions))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _once(col: Column) -> Column:
    """``col``, kept from being copied into what uses it.

    The optimizer moves filters below projections and repeats their expressions
    there; inside a lambda an array would then be made again for each element.
    A column that counts as nondeterministic stays where it is.
    """
    return F.when(F.spark_partition_id() >= 0, col)


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and the features ``_q_*``.

    Repeated three-word windows are found inside the row: windows are hashed to
    64 bits, and only a text that has an equal pair of them sorts its windows
    with their places.  There is no explode and no shuffle, so a very long text
    or a hot group of copies costs its own length only.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_q_t", t)
    df = df.withColumn("_q_w", _once(F.filter(F.split("_q_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    df = df.withColumn("_q_l", _once(F.filter(F.split("_q_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)))
    df = df.withColumn("n_words", F.size("_q_w").cast("long"))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.slice("_q_w", 1, F.size("_q_w") - 2), lambda w, i: F.xxhash64(w, F.get("_q_w", i + 1), F.get("_q_w", i + 2))))
    df = df.withColumn("_q_h", _once(F.coalesce(windows, F.array().cast("array<bigint>"))))
    df = df.withColumn("_q_rep", _once(F.size(F.array_distinct("_q_h")) < F.size("_q_h")))
    df = df.withColumn("_q_s", _once(F.when(F.col("_q_rep"), F.array_sort(F.transform("_q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    # Places of windows that have an equal neighbour, in order; each adds the words that the one before did not cover.
    equal = lambda x, at: F.coalesce(F.get("_q_s", at)["h"] == x["h"], F.lit(False))
    repeated = F.transform(F.filter("_q_s", lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["i"])
    df = df.withColumn("_q_p", _once(F.array_sort(repeated)))
    covered = F.aggregate("_q_p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", _once(F.when(F.col("_q_rep"), covered).otherwise(0).cast("long")))
    df = df.withColumn("n_dup_lines", (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long"))
    df = df.withColumn("word_chars", _without(F.col("_q_t"), SPACES).cast("long"))
    n = F.length("_q_t")
    df = df.withColumn("n_symbols", (n - _without(F.col("_q_t"), SYMBOLS)).cast("long"))
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "_q_n_lines"))
    df = df.withColumn("_q_n_lines", F.size("_q_l"))
    values = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": (n - _without(F.col("_q_t"), UPPER)) / chars,
        "mark_ratio": (n - _without(F.col("_q_t"), "!?")) / words,
        "digit_ratio": (n - _without(F.col("_q_t"), "0123456789")) / chars,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "line_words": F.col("n_words") / lines,
    }
    df = df.withColumns({f"_q_{k}": v.cast("double") for k, v in values.items()})
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).drop("_q_t", "_q_w", "_q_l", "_q_h", "_q_s", "_q_p", "_q_rep", "_q_n_lines")


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _thresholds(values: list[float], most: int = 48) -> list[float]:
    v = sorted(values)
    return sorted({v[(len(v) - 1) * k // most] for k in range(1, most)})


def _grow(rows: list, precise: float, most: int = 4) -> Rule | None:
    taken: list[Condition] = []
    while len(taken) < most:
        p0, n0 = sum(y for _, y in rows), sum(not y for _, y in rows)
        if not p0 or p0 / (p0 + n0) >= precise:
            break
        best, gain = None, 0.0
        for k, name in enumerate(FEATURES):
            pos, neg = sorted(x[k] for x, y in rows if y), sorted(x[k] for x, y in rows if not y)
            i = j = 0
            for t in _thresholds(pos + neg):
                while i < len(pos) and pos[i] < t:
                    i += 1
                while j < len(neg) and neg[j] < t:
                    j += 1
                for at_least, p, n in ((True, len(pos) - i, len(neg) - j), (False, i, j)):
                    if (g := _gain(p0, n0, p, n)) > gain + 1e-12:
                        best, gain = Condition(name, at_least, t), g
        if best is None:
            break
        taken.append(best)
        rows = [r for r in rows if best.holds(r[0])]
    return Rule(tuple(taken)) if taken else None


def _precision(rule: Rule, rows: list) -> tuple[float, int]:
    p = sum(1 for x, y in rows if y and rule.holds(x))
    n = sum(1 for x, y in rows if not y and rule.holds(x))
    return (p + 1) / (p + n + 2), p


def _prune(rule: Rule, rows: list) -> Rule:
    """Drop conditions while the pruning rows are covered at least as purely."""
    while len(rule.conditions) > 1:
        now = _precision(rule, rows)[0]
        shorter = max((Rule(rule.conditions[:k] + rule.conditions[k + 1 :]) for k in range(len(rule.conditions))), key=lambda r: _precision(r, rows))
        if _precision(shorter, rows)[0] < now:
            break
        rule = shorter
    return rule


def cover(rows: list[tuple[tuple, bool]], max_rules: int = 12, precise: float = 0.99, least: int = 3) -> list[Rule]:
    """Sequential covering.  rows: (features, is of low quality), in a fixed order; every third is for pruning."""
    grow, prune = [r for k, r in enumerate(rows) if k % 3], [r for k, r in enumerate(rows) if k % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules and sum(y for _, y in grow) >= least:
        rule = _grow(grow, precise)
        if rule is None:
            break
        rule = _prune(rule, prune)
        purity, hits = _precision(rule, prune)
        if purity < 0.9 or hits < least:
            break
        rules.append(rule)
        grow, prune = ([r for r in x if not rule.holds(r[0])] for x in (grow, prune))
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000) -> list[Rule]:
    """Rules from the statistics of the ``max_labelled`` labelled rows with the smallest id hashes (a documented bound)."""
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q_y"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # At most max_labelled rows of 12 bytes: broadcast, so that texts are not shuffled.
    known = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_q_id")), F.col("doc_id") == F.col("_q_id"))
    # One row an id, whatever number of documents repeats it.
    features = F.struct(*[f"_q_{f}" for f in FEATURES])
    got = text_statistics(known).groupBy(F.xxhash64("doc_id").alias("h"), "doc_id", "_q_y").agg(F.min(features).alias("x")).collect()
    got.sort(key=lambda r: tuple(r))
    return cover([(tuple(r["x"]), r["_q_y"] == 0) for r in got])


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``rule`` (the number of the rule that rejects, else null)."""
    df = text_statistics(set_aside(docs, RESULTS))
    hit = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        hit = F.when(rule.column(), F.lit(k)).otherwise(hit)
    df = df.withColumn("rule", hit)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that ``apply`` keeps, with their columns as they are."""
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"))
    return apply(packed, rules).where("kept").select("_q_row.*")
