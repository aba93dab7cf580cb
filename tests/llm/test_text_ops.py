import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from answerscope.llm import fingerprints, license_scan, shards, url_filters
from answerscope.llm.queries import ORACLES, QUERIES

from .. import oracle


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, small, name):
    oracle.compare(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name])


def test_url_rules(spark):
    urls = {
        "http://EXAMPLE.org/es/x": ("example.org", "/es/x", "example.org/es/", "block"), "http://a.example.org/en/17?q#f": ("a.example.org", "/en/17", "example.org/en/1", "block"), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.org": ("x.org", "", None, "allow"), "https://a.com/fr/1": ("a.com", "/fr/1", "com/fr/", "allow"), "https://casino.com/fr/1": ("casino.com", "/fr/1", "com/fr/", "allow"), "https://casino.net/a": ("casino.net", "/a", None, "block"),
        "https://best-casino.net?x": ("best-casino.net", "", None, "block"), "https://occasino.net/": ("occasino.net", "/", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), "x://": ("", "", None, "allow"), "http://a.com\n/de/": ("a.com\n", "/de/", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, None])], "page_id long, url string, tokens string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(df).collect()}
    assert got == urls | {None: ("", "", None, "allow")}
    assert url_filters.judge(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge(df, pattern_rules=[url_filters.pattern_rule("x", ".*")])


def test_patterns_decide_what_tokens_cannot(spark):
    """Each pair holds the same tokens; only the first fits its rule."""
    pairs = {
        "calendar": ("http://a.net/calendar/2021/05", "http://a.net/2021/05/calendar"), "cgi-script": ("http://a.net/cgi-bin/x.pl?y", "http://a.net/cgi-bin/about-pl"), "deep-page": ("http://a.net/l?page=1000", "http://a.net/l?page=999"), "doorway-cheap": ("http://www.cheap-shoes.net/", "http://www.shoes.net/cheap"),
        "free-download": ("http://a.net/x-free-full-download.zip", "http://a.net/free/of/download"), "login": ("http://a.net/wp-login.php", "http://a.net/wp/login/php"), "numeric-host": ("http://10.2.3.4/index.php?id=7", "http://a10.2.3.net/index.php?id=7"), "print-version": ("http://a.net/x?a=b&print=1", "http://a.net/print?1"),
        "reply-link": ("http://a.net/p?replytocom=12", "http://a.net/replytocom"), "session-java": ("http://a.net/x;JSESSIONID=0123456789abcdef", "http://a.net/x;jsessionid=none"), "session-php": ("http://a.net/?phpsessid=0123456789abcdef", "http://a.net/?phpsessid=0"), "link-farm": ("http://spam0.best-farm.net/", "http://a.net/farm"), "unwanted:casino": ("http://a.net/casino?x", "http://a.net/?u=/casino/"),
    }
    df = spark.createDataFrame([(k, u) for k, pair in pairs.items() for u in pair], "want string, url string")
    got = {r["url"]: r["pattern"] for r in url_filters.judge(df).collect()}
    assert got == {u: (k if n == 0 else None) for k, pair in pairs.items() for n, u in enumerate(pair)}


def test_url_ties_long_urls_and_clashing_names(spark):
    rules = [url_filters.host_rule("allow", "aa.net/"), url_filters.host_rule("block", "a.net/x"), url_filters.host_rule("allow", "a.net/y")]
    urls = ["http://aa.net/", "http://a.net/x", "http://a.net/y", "http://a.net/" + "z/" * 200_000 + "casino/", "http://b.net?x.a.net/y"]
    df = spark.createDataFrame([(u, "mine", "mine", "mine", "mine", "mine") for u in urls], "url string, host string, path string, rule string, pattern string, verdict string")
    got = {r["url"]: r for r in url_filters.judge(df, rules).collect()}
    assert [got[u]["verdict"] for u in urls] == ["allow", "block", "allow", "block", "allow"] and got[urls[3]]["pattern"] == "unwanted:casino" and got[urls[4]]["rule"] is None
    assert all(r[f"{c}_in"] == "mine" for r in got.values() for c in ("host", "path", "rule", "pattern", "verdict"))
    both = [url_filters.host_rule("allow", "a.net/"), url_filters.host_rule("block", "a.net/")]
    assert url_filters.judge(df, both).where("rule is not null").select("verdict").distinct().collect() == [("block",)]


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [url_filters.pattern_rule("r", "a-b", "a", "b")]
    slots = url_filters._slots(rules, {"a": 5, "b": 2}, 16)
    assert [e[0] for s in slots for e in s] == ["b"]


def in_next_order(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def edited_rows(rows):
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        yield i, t, u, t[: len(t) - len(t) // 3] + u[: len(t) // 3]


def test_fingerprints_equal_brute_force(odd, empty):
    c = fingerprints.canonical
    rows = in_next_order(odd)
    groups = Counter(c(t) for _, t in rows)
    smallest = {f: min((i for i, t in rows if c(t) == f and i is not None), default=None) for f in groups}
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(c(t)), fingerprints.digest(c(e)), float(c(t) == c(e)), float(c(t) == c(u)), smallest[c(t)], groups[c(t)]) for i, t, u, e in edited_rows(rows)]
    for ranges in (1, 3, 9):
        assert sorted(map(tuple, fingerprints.fingerprints(odd, ranges).collect()), key=repr) == sorted(want, key=repr)
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 11")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    with pytest.raises(TypeError):
        fingerprints.fingerprints(odd.withColumn("doc_id", F.lit("x")))


def test_op9_equals_brute_force_on_the_whole_table(spark, small):
    c, d = fingerprints.canonical, fingerprints.digest
    rows = in_next_order(spark.read.parquet(f"{small}/documents.parquet"))
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), d(c(t)), d(c(e)), float(c(t) == c(e)), float(c(t) == c(u))) for i, t, u, e in edited_rows(rows)}
    assert {r[0]: tuple(r)[1:7] for r in QUERIES["op9_fingerprints"](spark, small).collect()} == want


def test_canonical_form_and_groups(spark, odd):
    assert fingerprints.canonical("Ｆｕｌｌ  ﬁne\u00a0Straße\n") == fingerprints.canonical("full FINE strasse") == b"full fine strasse"
    got = {r["doc_id"]: (r["group_id"], r["copies"]) for r in fingerprints.group_copies(odd).collect()}
    assert got[1] == got[2] == (1, 2) and got[3] == (3, 1) and got[4] == got[5] == got[6] == (4, 3)


@pytest.mark.parametrize("broadcast_rows", [0, 400_000])
def test_equal_digests_are_told_apart(odd, monkeypatch, broadcast_rows):
    """With digests of two values nearly all forms clash, and bytes still decide."""
    monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", broadcast_rows)
    colliding = lambda form: str(len(form) % 2)
    c = fingerprints.canonical
    want = {r["doc_id"]: r["group_id"] for r in fingerprints.group_copies(odd).collect()}
    assert {r["doc_id"]: r["group_id"] for r in fingerprints.group_copies(odd, colliding).collect()} == want
    got = fingerprints.fingerprints(odd, 3, colliding).collect()
    assert len(got) == odd.count() and {r["doc_id"]: r["group_id"] for r in got} == want
    form_of, name_of = {}, {}
    rows = list(edited_rows(in_next_order(odd)))
    for r in got:
        i, t, u, e = next(x for x in rows if x[0] == r["doc_id"] and hashlib.sha256(x[3].encode()).hexdigest() == r["edited_sha256"])
        for name, form in ((r["fingerprint"], c(t)), (r["edited_fingerprint"], c(e))):
            assert form_of.setdefault(name, form) == form and name_of.setdefault(form, name) == name
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"]) == float(c(t) == c(e)) and r["near_next"] == float(c(t) == c(u))


def test_shard_store(spark, odd, empty, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20, fan_in=3)
    with pytest.raises(FileNotFoundError):
        store.read()
    docs = spark.createDataFrame(odd.collect(), odd.schema)
    for a in shards.arrivals(docs, 4):
        store.append(a.coalesce(1))
    store.append(empty.coalesce(1))
    before, n = store.shards(), store.versions()[-1]
    assert store.compact() and len(store.shards()) < len(before)
    for version in (n, None):  # an older version is still whole
        assert sorted(map(repr, store.read(version).collect())) == sorted(map(repr, odd.collect()))
    with pytest.raises(shards.Conflict):
        store.commit(n, set(), [])
    assert store.vacuum() == len(before) - len(set(before) & set(store.shards())) and store.read().count() == odd.count()
    assert not store.compact()


def test_concurrent_appends_and_merges_lose_nothing(spark, tmp_path, monkeypatch):
    """Six threads append while one compacts; every row is there once, and parts stay small."""
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(shards, "PART", 3)
    root = f"file://{tmp_path}/s"
    new = lambda: shards.ShardStore(spark, root, target=1 << 20, fan_in=3)
    new().append(spark.range(100, 110).coalesce(1))
    with ThreadPoolExecutor(7) as pool:
        jobs = [pool.submit(lambda k=k: new().append(spark.range(10 * k, 10 * k + 10).coalesce(1))) for k in range(10)]
        merges = [pool.submit(lambda: new().compact()) for _ in range(2)]
        versions = [j.result() for j in jobs]
        [m.result() for m in merges]
    store = new()
    assert len(set(versions)) == 10 and sorted(r["id"] for r in store.read().collect()) == list(range(110))
    assert all(len(store._part(p)) <= 3 for p in store.parts(store.latest()))
    store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == list(range(110)) and store.versions() == list(range(1, store.latest() + 1))


def test_an_append_during_a_merge_is_kept(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fan_in=2)
    for k in range(2):
        store.append(spark.range(k, k + 1).coalesce(1))
    write = store._write

    def slow(df, version):
        out = write(df, version)
        store._write = write
        store.append(spark.range(7, 8).coalesce(1))
        return out

    store._write = slow
    store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == [0, 1, 7]


def test_op6_returns_every_document(spark, small):
    import zlib

    got = sorted((r["doc_id"], r["n_chars"], r["text_crc32"]) for r in QUERIES["op6_sharding"](spark, small).collect())
    assert got == sorted((r["doc_id"], r["n_chars"], zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{small}/documents.parquet").collect())


def test_license_scan(spark):
    rows = [
        ("f1", "/a/b", False, "# Licensed under the Apache License, Version 2.0.\ncode"), ("f2", "/a/b/c", False, "code"), ("LICENSE", "/a", True, "Released under the MIT License."), ("f3", "/a/x", False, None), ("f4", "/z", False, "license to thrill, and more unrelated words here"),
        ("f5", None, False, "x"), ("f6", "/a/g", True, "This work is licensed under the GNU General Public License, version 3."), ("f7", "/a/g/h/", False, ""), (None, "/a", False, "Licensed under CC BY-NC 4.0."), ("f8", "/ab", False, "code"),
    ]
    df = spark.createDataFrame(rows, "file string, directory string, is_license_file boolean, text string").withColumn("license", F.lit("clash")).withColumn("line", F.lit(1))
    got = {r["file"]: (r["license"], r["inherited_from"]) for r in license_scan.scan(df).collect()}
    assert got == {"f1": ("Apache-2.0", None), "f2": ("MIT", "/a"), "LICENSE": ("MIT", None), "f3": ("MIT", "/a"), "f4": (None, None), "f5": (None, None), "f6": ("GPL-3.0", None), "f7": ("GPL-3.0", "/a/g"), None: ("CC-BY-NC-4.0", None), "f8": (None, None)}
    assert license_scan.scan(df.where("false")).count() == 0
    assert license_scan.scan(df.where("text is null")).select("license").collect() == [(None,)]
    twice = spark.createDataFrame([("x", "/a", False, "Released under the MIT License."), ("x", "/a", False, "Licensed under CC BY-SA 4.0."), ("x", "/a", False, "Licensed under CC BY-SA 4.0."), ("x", None, None, None)], "file string, directory string, is_license_file boolean, text string")
    assert sorted(str(r["license"]) for r in license_scan.scan(twice).collect()) == ["CC-BY-SA-4.0", "CC-BY-SA-4.0", "MIT", "None"]


def test_headers_and_license_texts(spark):
    """Wrapped headers in comments, whole license files, and long texts; ties go to the smaller name."""
    import textwrap

    of = dict(reversed(license_scan.TEMPLATES))
    whole = {k: max((t for n, t in license_scan.TEMPLATES if n == k), key=len) for k in of}
    header = lambda k, mark: "\n".join(mark + x for x in textwrap.wrap(whole[k], 70))
    rows = [
        ("gpl2.c", "/*\n" + header("GPL-2.0", " * ") + "\n */\n\nint main() {}\n" * 500, "GPL-2.0"), ("gpl3.py", "#!/usr/bin/env python\n#\n" + header("GPL-3.0", "# ") + "\n\nimport os", "GPL-3.0"),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2019 Jane Roe. All rights reserved.\n\n" + header("MIT", ""), "MIT"), ("BSD3", "Copyright (c) 2001, Some Body\nAll rights reserved.\n\n" + header("BSD-3-Clause", ""), "BSD-3-Clause"),
        ("BSD2", "Copyright (c) 2001, Some Body\nAll rights reserved.\n\n" + header("BSD-2-Clause", ""), "BSD-2-Clause"), ("isc", header("ISC", "// "), "ISC"), ("apache", header("Apache-2.0", "-- "), "Apache-2.0"), ("own", "x\nCopyright 2020. All rights reserved.\ny", "Proprietary"),
        ("long", "word " * 100_000 + "\nReleased under the MIT License.\n" + "z" * 100_000, "MIT"), ("prose", "A license to sing.\nThe copyright of this song is with its singer, and nobody else may sing it.", None), ("tie", "Licensed under CC BY-SA 4.0.\nReleased under the MIT License.", "CC-BY-SA-4.0"),
    ]
    df = spark.createDataFrame([(f, "/" + f, f.isupper(), t) for f, t, _ in rows], "file string, directory string, is_license_file boolean, text string")
    assert {r["file"]: r["license"] for r in license_scan.scan(df).collect()} == {f: w for f, _, w in rows}


GNU_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the {0} as published by
the Free Software Foundation, either version {1} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{0} for more details.

You should have received a copy of the {0}
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_versions_of_one_family_are_told_apart(spark):
    """Headers of three paragraphs as they are used, in comments of several kinds and as plain text, identifiers, and denials."""
    rows = []
    for name, version, want in (("GNU General Public License", "3", "GPL-3.0"), ("GNU General Public License", "2", "GPL-2.0"), ("GNU Affero General Public License", "3", "AGPL-3.0"), ("GNU Lesser General Public License", "2.1", "LGPL-2.1"), ("GNU Lesser General Public License", "3", "LGPL-3.0")):
        text = GNU_TEXT.format(name, version)
        marked = lambda mark, text=text: "".join(f"{mark}{x}\n" for x in text.split("\n"))
        rows += [(f"{want} plain", "Some program.\nCopyright (C) 2020 A. Person\n\n" + text + "\nint main() {}\n", want), (f"{want} #", marked("# ") + "import os\n", want), (f"{want} *", "/*\n" + marked(" * ") + " */\nint x;\n", want), (f"{want} crlf", marked("; ").replace("\n", "\r\n"), want)]
    rows += [("spdx", f"// SPDX-License-Identifier: {x}\nint x;", x) for x in ("MIT", "ISC", "AGPL-3.0", "MPL-1.1", "CC0-1.0")]
    rows = [(f"{k} {f}", t, w) for k, (f, t, w) in enumerate(rows)]
    rows += [("or later", "# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("denied", "This is not released under the MIT License.", None), ("never", "It was never licensed under the Apache License, Version 2.0", None)]
    # What versions share names the family and no version, where nothing else is there: the nearest one is given.
    rows.append(("shared only", GNU_TEXT.split("\n\n")[1].format("GNU General Public License"), "GPL"))
    df = spark.createDataFrame([(f, "/" + str(k), False, t) for k, (f, t, _) in enumerate(rows)], "file string, directory string, is_license_file boolean, text string")
    got = {r["file"]: r["license"] for r in license_scan.scan(df).collect()}
    assert {f: x if f != "shared only" else x.split("-")[0] for f, x in got.items()} == {f: w for f, _, w in rows}


def test_whole_license_texts_of_this_machine(spark):
    """Texts that no template repeats, where the system has them."""
    import os

    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    folder = "/usr/share/common-licenses"
    have = {n: open(f"{folder}/{n}", errors="replace").read() for n in want if os.path.exists(f"{folder}/{n}")}
    if not have:
        pytest.skip("no license texts here")
    df = spark.createDataFrame([(n, "/" + n, True, t) for n, t in have.items()], "file string, directory string, is_license_file boolean, text string")
    assert {r["file"]: r["license"] for r in license_scan.scan(df).collect()} == {n: want[n] for n in have}
