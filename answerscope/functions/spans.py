"""Places of names in texts, as Column builders: everything runs inside the row, in the JVM.

A span is a struct of ``start`` and ``end``, 0-based, in characters, its end excluded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE, compressed, js_trim, regex_escape

SPAN = "struct<start:int,end:int>"
#: Words that a compressed label may be written in, and the characters of a word.
LABEL_WORDS, WORD = 4, "A-Za-z0-9&"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _laid_out(gaps: Column, lengths: Column) -> Column:
    """Spans from the texts between matches and the lengths of the matches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a, x):
        begin = (a["at"] + F.length(x["gap"])).cast("int")
        end = (begin + x["n"]).cast("int")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(lengths)).alias("gap"), lengths.alias("n"))
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def matches(text: Column, pattern: Column) -> Column:
    """Spans of all matches of a pattern, left to right."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    spans = _laid_out(F.split(text, pattern, -1), F.transform(found, lambda m: F.length(m)))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def name_spans(text: Column, name: Column) -> Column:
    """Whole-word mentions of a name in any case, by ASCII boundaries."""
    return matches(text, F.concat(F.lit(f"{EDGE}(?i:"), regex_escape(name), F.lit(f"){EDGE}")))


def label_spans(text: Column, label: Column) -> Column:
    """Runs of up to ``LABEL_WORDS`` words that spell ``label`` when written together; labels of under three letters have none."""
    key = compressed(label)
    letters = F.array_join(F.filter(F.split(key, ""), lambda c: c != ""), f"[^{WORD}]*")
    found = matches(text, F.concat(F.lit(f"(?i)(?<![{WORD}])"), letters, F.lit(f"(?![{WORD}])")))
    words = lambda s: F.size(F.split(text.substr(s["start"] + 1, s["end"] - s["start"]), f"[^{WORD}]+"))
    return F.when(F.length(key) >= 3, F.filter(found, lambda s: words(s) <= LABEL_WORDS)).otherwise(F.array().cast(f"array<{SPAN}>"))


def longest_first(names: Column) -> Column:
    """An array of structs with a ``name`` by the length of the name, descending; equal lengths keep their order."""
    placed = F.transform(names, lambda x, k: F.struct((-F.length(x["name"])).alias("n"), k.alias("k"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def claims(text: Column, names: Column) -> Column:
    """What each of ``names`` (structs of ``name`` and ``label``, a boolean) claims of a text, the longest name first.

    A mention that lies inside one that is claimed already does not count, so a short name inside a longer one is not counted
    twice; one that only overlaps does.  Labels match runs of words, names match as they are.  The result has an element of ``name, hits``
    for each of the names, in order of claiming.
    """
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("taken"), F.array().cast(f"array<struct<name:string,hits:array<{SPAN}>>>").alias("out"))

    def step(a, x):
        all_ = F.when(x["label"], label_spans(text, x["name"])).otherwise(name_spans(text, x["name"]))
        free = F.filter(all_, lambda h: ~F.exists(a["taken"], lambda c: (c["start"] <= h["start"]) & (h["end"] <= c["end"])))
        # Bound once: the lambda over an array of one element stands for a variable.
        return F.element_at(F.transform(F.array(free), lambda f: F.struct(F.concat(a["taken"], f).alias("taken"), F.concat(a["out"], F.array(F.struct(x["name"].alias("name"), f.alias("hits")))).alias("out"))), 1)

    return F.aggregate(longest_first(names), start, step, lambda a: a["out"])


def shown(text: Column, span: Column) -> Column:
    """The text of a span on one line."""
    return js_trim(F.regexp_replace(text.substr(span["start"] + 1, span["end"] - span["start"]), r"\s+", " "))
