"""What the sources of a record speak of and its answer leaves out.

A record's vocabulary (the names it knows) is matched with each of its sources by a set intersection of
compressed names with the words of the source's text, written together or not, so a squashed name still meets how a
snippet writes it.  Both sides lie in one row: the match needs no shuffle, and only what was found leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.brands import NOISE
from ..functions.spans import LABEL_WORDS, UPPER, WORD
from ..functions.text import EDGE, bound, compressed, js_trim, regex_escape

#: Categories of entities that are names of companies or places.
NAMING = "brand|company|organization|vendor|place|business"
#: Words that show that a model's name ran on into a sentence, and beginnings that are no model's name.
RUN_ON = "so you do the is was are an and but that this which who how why what its it's from has have will can could would were".split()
NO_MODEL = "and or with for in under laptop phone price spec review".split()
#: Mentions of one name in one source that are looked at for a model.
MENTIONS = 20


def vendor_of(title: Column) -> Column:
    """The first word of a product's name without quotes and brackets; null if it is no name."""
    first = F.regexp_replace(F.split(js_trim(title), r"\s+")[0], r"[^A-Za-z0-9_&.\-]", "")
    return bound(first, lambda f: F.when(f.rlike("^[A-Za-z]") & ~F.lower(f).isin(*sorted(NOISE)), f))


def vocabulary(records: DataFrame) -> Column:
    """``key`` (compressed) and ``name`` of what a record knows: mentions, products' brands or vendors, places, entities that name a company or place; the first of equal keys."""
    none = F.array().cast("array<string>")
    own = lambda column, f: F.coalesce(F.transform(column, f), none) if column in records.columns else none
    blank = lambda c: F.when(c != "", c)
    entities = F.filter("entities", lambda e: F.coalesce(e["category"], F.lit("")).rlike(f"(?i){NAMING}")) if "entities" in records.columns else None
    names = F.concat(
        own("brand_mentions", lambda b: b["brand"]), own("products", lambda p: F.coalesce(blank(p["brand"]), vendor_of(p["name"]))), own("places", lambda p: p["name"]),
        none if entities is None else F.coalesce(F.transform(entities, lambda e: e["text"]), none),
    )
    clean = F.transform(names, lambda n: F.regexp_replace(js_trim(n), "[*_`]", ""))
    known = F.filter(F.transform(clean, lambda n: F.named_struct(F.lit("key"), compressed(n), F.lit("name"), n)), lambda v: F.length(v["name"]).between(3, 60) & (F.length(v["key"]) >= 3))
    return bound(known, lambda vs: bound(F.transform(vs, lambda v: v["key"]), lambda keys: F.filter(vs, lambda v, k: F.array_position(keys, v["key"]) == k + 1)))


def spoken_of(text: Column, known: Column) -> Column:
    """The entries of a vocabulary that a text names, as they are or as a run of words that spells them."""
    # Runs of words do not show names of more words, names with other letters, or names next to an ampersand.
    plain = rf"^[^A-Za-z0-9]*(?:[A-Za-z0-9]+[\x00-%'-/:-@\[-`{{-\x7f]*){{1,{LABEL_WORDS}}}$"
    verbatim = lambda v: (F.contains(text, F.lit("&")) | ~v["name"].rlike(plain)) & F.rlike(text, F.concat(F.lit(f"{EDGE}(?i:"), regex_escape(v["name"]), F.lit(f"){EDGE}")))
    words = F.concat(F.lit(" "), F.regexp_replace(F.translate(text, UPPER, UPPER.lower()), f"[^{WORD}]+", " "), F.lit(" "))

    def spelt(v, words, together):
        """A run of words that spells the key: its letters from the beginning of a word to the end of one, wherever words part; looked for only where the words, written together, have the key at all."""
        runs = F.regexp_extract_all(words, F.concat(F.lit("(?<= )(?=("), F.regexp_replace(v["key"], "(?<=.)(?=.)", " ?"), F.lit(") )")), F.lit(1))
        return F.contains(together, v["key"]) & F.exists(runs, lambda r: F.length(r) - F.length(v["key"]) < LABEL_WORDS)

    return bound(words, lambda w: bound(F.replace(w, F.lit(" ")), lambda t: F.filter(known, lambda v: spelt(v, w, t) | verbatim(v))))


def models_after(text: Column, name: Column) -> Column:
    """What follows mentions of a name and reads like a model: up to 21 letters, digits, dots, dashes and spaces that hold no word of a sentence."""
    found = F.regexp_extract_all(text, F.concat(F.lit(f"(?i){EDGE}"), regex_escape(name), F.lit(r"\s+([A-Za-z0-9][A-Za-z0-9\-.\s]{1,20})")), F.lit(1))
    # The pattern runs only where the name is there at all, in whatever case of A-Z.
    low = lambda c: F.translate(c, UPPER, UPPER.lower())
    found = F.when(F.contains(low(text), low(name)), found).otherwise(F.array().cast("array<string>"))
    said = F.transform(F.slice(found, 1, MENTIONS), lambda m: F.trim(F.substring_index(js_trim(m), "\n", 1)))
    run_on = rf"(?i){EDGE}(?:{'|'.join(RUN_ON)}){EDGE}|^(?:{'|'.join(NO_MODEL)})"
    return F.filter(said, lambda m: F.length(m).between(2, 24) & ~m.rlike(run_on))


def evaluated(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``capture_id, brand, kind, sources, models``: a row a record and brand.

    Kind ``omitted``: sources (their places, from 0) speak of the brand and the answer does not narrate it.  Kind ``ignored models``:
    the answer narrates the brand and leaves out these models, which sources name.  ``aliases`` maps lower-case names to the brand they stand for.
    """
    stands = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    canon = lambda n: n if stands is None else F.coalesce(F.element_at(stands, F.lower(n)), n)
    none = F.array().cast("array<string>")
    told = F.transform(F.filter("brand_mentions", lambda b: b["count"] > 0), lambda b: F.lower(canon(b["brand"])))
    text = lambda s: F.concat_ws(" ", F.coalesce(s["title"], F.lit("")), F.coalesce(s["snippet"], F.lit("")))
    df = records.select("capture_id", vocabulary(records).alias("known"), F.coalesce(told, none).alias("told"), F.lower(F.coalesce("answer_text", F.lit(""))).alias("answer"), F.posexplode(F.transform("sources", text)).alias("source", "text"))
    df = df.select("capture_id", "told", "answer", "source", "text", F.posexplode(spoken_of(F.col("text"), F.col("known"))).alias("place", "v"))
    df = df.withColumn("models", models_after(F.col("text"), F.col("v.name"))).withColumn("brand", canon(F.col("v.name")))
    left = F.filter("models", lambda m: ~F.contains(F.col("answer"), F.lower(m)))
    narrated = F.array_contains("told", F.lower("brand"))
    df = df.select("capture_id", F.lower("brand").alias("key"), "brand", "source", "place", narrated.alias("narrated"), F.when(narrated, left).otherwise(F.col("models")).alias("models"))
    at = F.struct("source", "place")
    of = df.groupBy("capture_id", "key").agg(F.max_by("brand", at).alias("brand"), F.bool_or("narrated").alias("narrated"), F.sort_array(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_list(F.struct("source", "place", "models"))).alias("parts"))
    named = F.flatten(F.transform("parts", lambda p: p["models"]))
    low = F.transform(named, lambda m: F.lower(m))
    models = bound(low, lambda low: F.filter(named, lambda m, k: F.array_position(low, F.lower(m)) == k + 1))
    of = of.select("capture_id", "brand", F.when(F.col("narrated"), "ignored models").otherwise("omitted").alias("kind"), F.when(F.col("narrated"), F.array().cast("array<int>")).otherwise(F.col("sources")).alias("sources"), models.alias("models"))
    return of.where("kind = 'omitted' or size(models) > 0")
