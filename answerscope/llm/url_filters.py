"""URL filters (native: DataFrame functions only).

A rule has a pattern (a regular expression over ``host + path + rest``, of which
only the host is lower-cased) and literal tokens that every URL it matches must
hold whole.  The index files each
rule under its rarest literal token, rarest by how many rows of the judged
table hold it, so the rules of a frequent token such as ``com`` are not tried
on every URL.  The index is a hash table of a fixed number of slots, a literal
array inside the plan: looking up the tokens of a URL is done inside its own
row, without explode, join or shuffle, so hot hosts and repeated URLs cost no
more than others.  Only the rules fetched by a token run their expression.

Host rules such as ``example.org/es/`` are compiled to the same form.  Of the
host rules that fit, the longest decides; without one, a pattern rule that fits
blocks, else the URL is allowed.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is allowed; hosts are lower-cased over A-Z only; rules of equal length are
decided block before allow, then by the greater name; a URL of any length is
looked at whole; repeated rows are judged each; an empty table gives no rows;
extra columns pass through, and one that is named like a result comes back as
``<name>_in``; names starting with ``_u_`` are reserved.  At most ``MAX_RULES`` rules are taken, as
the index is part of the plan; more raise an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import set_aside

MAX_RULES = 4096
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``decides`` is the length that ranks host rules; 0 for pattern rules, which only count where no host rule fits."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    decides: int = 0


def host_rule(verdict: str, rule: str) -> UrlRule:
    """``org/`` fits org and all its subdomains; the path is a prefix, so a token that the rule's end may cut is no key."""
    host, slash, path = rule.partition("/")
    text = f"{host}{slash}{path}"
    cut_off = re.search(r"[a-z0-9]+$", text) if path else None
    whole = text[: cut_off.start()] if cut_off else text
    tail = re.escape(slash + path) if slash else r"(?:[/?#]|$)"
    return UrlRule(rule, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{tail}", tuple(dict.fromkeys(_TOKEN.findall(whole.lower()))), len(text))


def pattern_rule(name: str, pattern: str, *tokens: str) -> UrlRule:
    """A blocking pattern; each of ``tokens`` is a whole token of every URL it matches."""
    return UrlRule(name, "block", pattern, tokens)


#: The query's host rules.
HOST_RULES = [host_rule("allow", "org/"), host_rule("block", "example.org/es/"), host_rule("block", "example.org/en/1"), host_rule("allow", "com/fr/"), host_rule("block", "com/de/")]

#: Tokens of unwanted sites; each stands as a whole label, or label part, of a host or path.
UNWANTED = ["adult", "ads", "adserver", "banner", "bet", "betting", "casino", "click", "clickbait", "doorway", "gambling", "lottery", "malware", "payday", "phishing", "pills", "poker", "popup", "porn", "replica", "sex", "spam", "torrent", "tracker", "viagra", "warez", "xxx"]

#: A word stands as a whole label, or part of one, of the host, or as a whole part of the path.
_PLACE = r"(?i)^(?:(?:[^/?#]*[^a-z0-9/?#])?{0}(?:[^a-z0-9]|$)|[^?#]*/{0}(?:[/._?#-]|$))"

#: Blocking patterns that the tokens alone cannot decide: where they stand, what follows them, how long it is.
PATTERN_RULES = [pattern_rule(f"unwanted:{w}", _PLACE.format(w), w) for w in UNWANTED] + [
    pattern_rule("link-farm", r"(?i)^(?:[^/?#]*[^a-z0-9/?#])?farm(?:[^a-z0-9]|$)", "farm"),
    pattern_rule("calendar", r"(?i)^[^?#]*/calendar/(?:19|20)[0-9]{2}[/-][0-9]{1,2}(?:[/?#-]|$)", "calendar"),
    pattern_rule("cgi-script", r"(?i)^[^?#]*/cgi-bin/[^?#]*[.](?:cgi|pl)(?:[?#]|$)", "cgi", "bin"),
    pattern_rule("deep-page", r"(?i)[?&]page=[1-9][0-9]{3,}(?:[&#]|$)", "page"),
    pattern_rule("doorway-cheap", r"(?i)^(?:[^/?#]*[.])?(?:[a-z0-9]+-)*cheap-[a-z0-9-]+[.]", "cheap"),
    pattern_rule("free-download", r"(?i)^[^?#]*[/-]free[_-](?:full[_-])?download(?:[/._?#-]|$)", "free", "download"),
    pattern_rule("login", r"(?i)^[^?#]*/wp-login[.]php(?:[?#]|$)", "wp", "login", "php"),
    pattern_rule("numeric-host", r"(?i)^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?::[0-9]+)?/(?:[^?#]*/)?index[.]php[?]id=[0-9]+", "index", "php", "id"),
    pattern_rule("print-version", r"(?i)[?&](?:[^#]*&)?print=(?:1|yes|true)(?:[&#]|$)", "print"),
    pattern_rule("reply-link", r"(?i)[?&]replytocom=[0-9]+(?:[&#]|$)", "replytocom"),
    pattern_rule("session-java", r"(?i);jsessionid=[0-9a-f]{16,}", "jsessionid"),
    pattern_rule("session-php", r"(?i)[?&]phpsessid=[0-9a-z]{16,}", "phpsessid"),
]


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased, after the first ``://`` up to ``/``, ``?``, ``#`` or the end), ``path`` and ``_u_rest``."""
    at = F.coalesce(F.locate("://", F.col(url)), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    df = df.withColumn("_u_tail", rest)
    # (?s): a line break is an ordinary character of a URL here.
    df = df.withColumn("host", F.translate(F.regexp_extract("_u_tail", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER))
    df = df.withColumn("path", F.regexp_extract("_u_tail", r"(?s)^[^/?#]*([^?#]*)", 1))
    return df.withColumn("_u_rest", F.regexp_extract("_u_tail", r"(?s)^[^?#]*(.*)$", 1)).drop("_u_tail")


def _tokens() -> Column:
    text = F.concat(F.col("host"), F.translate(F.concat("path", "_u_rest"), _UPPER, _LOWER))
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(urls: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """How many rows hold each token that some rule names: one pass, one number a token comes to the driver."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    got = urls.select(_tokens().alias("t")).agg(*[F.count_if(F.array_contains("t", n)).alias(f"c{k}") for k, n in enumerate(names)]).first()
    return dict(zip(names, got, strict=True))


def _slots(rules: list[UrlRule], counts: dict[str, int], n: int) -> list[list[tuple[str, UrlRule]]]:
    out: list[list[tuple[str, UrlRule]]] = [[] for _ in range(n)]
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
        out[xxhash.xxh64_intdigest(key.encode(), seed=42) % n].append((key, r))
    return out


def _entry(key: str, r: UrlRule) -> str:
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"named_struct('key', {q(key)}, 'rank', named_struct('decides', {r.decides}, 'blocks', {int(r.verdict == 'block')}, 'name', {q(r.name)}), 'verdict', {q(r.verdict)}, 'pattern', {q(r.pattern)})"


_TYPE = "array<struct<key:string,rank:struct<decides:int,blocks:int,name:string>,verdict:string,pattern:string>>"


def judge(pages: DataFrame, host_rules: list[UrlRule] = HOST_RULES, pattern_rules: list[UrlRule] = PATTERN_RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule`` (the host rule that decides, else null), ``pattern`` (the pattern rule that does) and ``verdict``."""
    rules = [*host_rules, *pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index holds {MAX_RULES} at most")
    if any(not r.tokens for r in rules):
        raise ValueError(f"rules without a literal token: {[r.name for r in rules if not r.tokens]}")
    df = split_url(set_aside(pages, [c for c in ("host", "path", "rule", "pattern", "verdict") if c != url]), url)
    n = max(16, 1 << max(0, 2 * len(rules) - 1).bit_length())
    slots = _slots(rules, rarest_tokens(df, rules), n)
    index = F.expr("array(" + ", ".join(f"cast(array({', '.join(_entry(*e) for e in s)}) as {_TYPE})" for s in slots) + ")")
    df = df.withColumn("_u_t", _tokens())
    # Row-local lookup: slot of each token, then the entries filed under exactly that token.
    found = F.flatten(F.transform("_u_t", lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda e: e["key"] == t)))
    df = df.withColumn("_u_c", found)
    df = df.withColumn("_u_s", F.concat("host", "path", "_u_rest"))
    fits = F.filter("_u_c", lambda e: F.regexp_like(F.col("_u_s"), e["pattern"]))
    best = F.array_max(F.transform(fits, lambda e: F.struct(e["rank"].alias("rank"), e["verdict"].alias("verdict"))))
    df = df.withColumn("_u_b", F.when(F.size("_u_c") > 0, best))
    df = df.withColumn("rule", F.when(F.col("_u_b.rank.decides") > 0, F.col("_u_b.rank.name")))
    df = df.withColumn("pattern", F.when(F.col("_u_b.rank.decides") == 0, F.col("_u_b.rank.name")))
    return df.withColumn("verdict", F.coalesce("_u_b.verdict", F.lit("allow"))).drop("_u_t", "_u_c", "_u_s", "_u_b", "_u_rest")
