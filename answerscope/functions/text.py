"""Column builders for names, prompts, URLs, dates and cells; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers know it.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same as characters to trim: no pattern walks over the text between its ends.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: An ASCII word boundary; Java's own is Unicode-aware.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Labels that registries put between a name and the country code.
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "gob", "gc")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once: inside ``f`` it is the variable of a lambda over an array of one element.

    A Column that is used several times, above all inside a lambda, is an expression that is computed each time.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def norm_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def duplicate_key(c: Column) -> Column:
    """Prompts that differ in case and spacing only are duplicates."""
    return F.regexp_replace(F.lower(js_trim(c)), f"{SPACE}+", " ")


def timeline_key(c: Column) -> Column:
    """Also without closing marks: repeated runs of one prompt."""
    return js_trim(F.regexp_replace(F.regexp_replace(F.lower(c), f"{SPACE}+", " "), r"[.?!,]+$", ""))


def frequency_key(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "(no prompt)").otherwise(js_trim(F.lower(c)))


def compressed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def title_case(c: Column) -> Column:
    """``home_audio`` -> ``Home Audio``: only first letters are raised."""
    words = F.filter(F.split(c, "[_-]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def is_http(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^https?://"), F.lit(False))


def domain_of_url(c: Column) -> Column:
    """Lower-case host without a leading ``www.``; a missing scheme is assumed; no host: empty."""
    url = F.when(c.rlike("(?i)^[a-z][a-z0-9+.-]*://"), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def domain_matches(source: Column, brand: Column) -> Column:
    """The same domain, or a subdomain of the brand's."""
    return (brand != "") & ((source == brand) | F.endswith(source, F.concat(F.lit("."), brand)))


def clean_url(c: Column) -> Column:
    """Without utm_source, utm_medium and utm_campaign; a ``?`` left with nothing goes."""
    out = F.regexp_replace(c, r"(?<=[?&])utm_(?:source|medium|campaign)=[^&#]*(?:&|(?=#)|$)", "")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


def brand_from_domain(c: Column) -> Column:
    """The registrable label, its first letter raised; labels of under three characters or of digits only give null."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(c), r"^www\.", ""), r"\."), lambda x: x != "")
    n = F.size(labels)
    second = F.element_at(labels, F.when(n >= 2, -2).otherwise(-1))
    label = F.when((n >= 3) & second.isin(*SECOND_LEVEL), F.element_at(labels, F.when(n >= 3, -3).otherwise(-1))).otherwise(second)
    return F.when((n >= 2) & (F.length(label) >= 3) & ~label.rlike("^[0-9]+$"), F.concat(F.upper(F.substring(label, 1, 1)), label.substr(F.lit(2), F.length(label))))


def bounded(name: str) -> str:
    """Pattern of a whole-word, case-insensitive mention."""
    return f"{EDGE}(?i:{re.escape(name)}){EDGE}"


def located(name: str) -> str:
    """As ``bounded``, but a name with a capital is not found in all lower case."""
    skip = f"(?!{re.escape(name.lower())})" if re.search("[A-Z]", name) else ""
    return f"{EDGE}{skip}(?i:{re.escape(name)}){EDGE}"


def mention_count(text: Column, name: str) -> Column:
    return F.regexp_count(text, F.lit(bounded(name))).cast("long")


def first_index(text: Column, name: str) -> Column:
    """0-based place of the first mention; null without one."""
    # The expression runs only where the name is there at all, in whatever case of A-Z.
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    there = F.contains(F.translate(text, upper, lower), F.lit(name.translate(str.maketrans(upper, lower))))
    at = F.regexp_instr(text, F.lit(located(name)))
    return F.when(there, F.when(at > 0, (at - 1).cast("long")))


def passage(text: Column, index: Column, around: int = 110) -> Column:
    start = F.greatest(index - around + 1, F.lit(1)).cast("int")
    cut = text.substr(start, (index + 1 + around - start).cast("int"))
    return js_trim(F.regexp_replace(cut, f"{SPACE}+", " "))


def word_count(c: Column) -> Column:
    t = js_trim(c)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.size(F.split(t, f"{SPACE}+")))


def csv_cell(c: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe; every cell is quoted."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))


def day_key(ts: Column) -> Column:
    return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")


def week_key(ts: Column) -> Column:
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def run_due(last: Column, now: Column) -> Column:
    return last.isNull() | (F.to_date(last) != F.to_date(now))


def seconds_or_millis(v: Column) -> Column:
    return F.timestamp_millis(F.when(v > 1e12, v).otherwise(v * 1000).cast("long"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def table_cells(line: Column) -> Column:
    """Cells of a markdown table row; an escaped pipe does not split."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.trim(F.regexp_replace(x, r"\\\|", "|")))


def duration_hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.concat_ws(":", F.floor(s / 3600).cast("string"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def plain_snippet(c: Column) -> Column:
    """A snippet without markdown: links by their text, no images, marks of headings, lists, code, emphasis and rules; one line."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}(?:#{1,6}|[-*+>]|\d+[.)])\s+", ""), (r"(?m)^\s*(?:[-*_]\s*){3,}$", " "), (r"[*_`~|]+", "")):
        c = F.regexp_replace(c, pattern, by)
    return js_trim(F.regexp_replace(c, f"{SPACE}+", " "))


#: What an "in ..." label of a list article opens with.
LISTICLE_OPENINGS = (r"you can buy", r"right now", r"approx\.?", r"approximately", r"overall", r"today", r"in [0-9]{4}")


def is_noise_label(c: Column) -> Column:
    """Of a category label: too short or long, made of separators or the rules of a table, or one that opens like the frame of a list article."""
    s = js_trim(c)
    n = F.length(s)
    frame = s.rlike(rf"^(?i:{'|'.join(LISTICLE_OPENINGS)}){EDGE}")
    return F.coalesce((n < 3) | (n > 60) | s.rlike(rf"^(?:{SPACE}|[-—–|:.])+$") | s.rlike(r"-{4,}|\|{2,}") | frame, F.lit(True))


def json_path(c: Column, path: str, kind: str = "string") -> Column:
    """A value in a JSON text; null where the text is no JSON, the path leads nowhere or the value is of another kind."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def text_fragment(url: Column, text: Column, most: int = 120) -> Column:
    """A link that jumps to a text on its page; null without a page."""
    return F.when(url != "", F.concat(url, F.lit("#:~:text="), F.replace(F.url_encode(js_trim(F.substring(text, 1, most))), F.lit("+"), F.lit("%20"))))
