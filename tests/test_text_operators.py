import random
import re

from pyspark.sql import functions as F

from answerscope.functions import brands, spans
from answerscope.operators import evidence, segments

TEXTS = ["HDFC Bank and hdfcbank, H D F C bank; hdfc-bank & HDFC&Bank.", "", None, "Angel One beats Angel. angel  one_two, Angel One", "é Acme é acmé ACME\nAcme", "a.b a+b A.B", "one two three four five onetwothreefour one-two three four"]
NAMES = ["HDFC Bank", "Hdfcbank", "Angel One", "Angel", "Acme", "a.b", "one two three four", "two"]


def ask(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).head()["x"]


def pairs(rows):
    return [(r["start"], r["end"]) for r in rows or []]


def plain_label(text, label):
    """Every run of up to four words that spells the label, the first that fits at each place."""
    key = re.sub("[^a-z0-9]", "", label.lower())
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer("[A-Za-z0-9&]+", text or "")]
    out, k = [], 0
    while k < len(words) and len(key) >= 3:
        n = next((n for n in range(1, 5) if k + n <= len(words) and "".join(w for _, _, w in words[k : k + n]) == key), 0)
        if n:
            out.append((words[k][0], words[k + n - 1][1]))
        k += n or 1
    return out


def test_spans_of_names_and_labels(spark):
    rows = spark.createDataFrame([(t, n) for t in TEXTS for n in NAMES], "t string, n string").select("t", "n", spans.name_spans(F.col("t"), F.col("n")).alias("a"), spans.label_spans(F.col("t"), F.col("n")).alias("b")).collect()
    for r in rows:
        assert pairs(r["a"]) == brands.spans(r["t"] or "", r["n"]), r
        assert pairs(r["b"]) == plain_label(r["t"], r["n"]), r


def test_claims_take_the_longest_first(spark):
    def plain(text, names):
        taken, out = [], {}
        for name, label in sorted(names, key=lambda x: -len(x[0])):
            hits = plain_label(text, name) if label else brands.spans(text, name)
            out[name] = [h for h in hits if not any(a <= h[0] and h[1] <= z for a, z in taken)]
            taken += out[name]
        return out

    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["Angel", "One", "angelone", "two", "One,", "Zed"]) for _ in range(40)), [(n, rng.random() < 0.4) for n in rng.sample(["Angel One", "Angel", "One", "One two Zed", "Zed One", "Angelone"], 5)]) for _ in range(30)]
    df = spark.createDataFrame(rows, "t string, names array<struct<name:string,label:boolean>>").select("t", "names", spans.claims(F.col("t"), F.col("names")).alias("c"))
    for r in df.collect():
        assert {c["name"]: pairs(c["hits"]) for c in r["c"]} == plain(r["t"], [tuple(n) for n in r["names"]])
        assert [len(c["name"]) for c in r["c"]] == sorted((len(c["name"]) for c in r["c"]), reverse=True)


def test_grams_and_empty_texts(spark):
    assert sorted(ask(spark, "HDFC bank & A-b cd", spans.grams)) == ["abcd", "bank", "bcd", "hdfc", "hdfcbank"]
    assert set(ask(spark, "one two three four five", spans.grams)) >= {"one", "onetwo", "onetwothreefour", "fourfive"} and "onetwothreefourfive" not in ask(spark, "one two three four five", spans.grams)
    assert ask(spark, "", spans.grams) == [] and ask(spark, "x & y", spans.grams) == []


def test_evaluated_against_omitted(spark):
    mention = lambda n, c: (n, c)
    source = lambda t, s: (t, s)
    rows = [
        ("a", [mention("Acme", 1), mention("Globex", 0)], [("", '"Sony" WH-1000', ), ("Bosch", "x")], [("Angel One",)], [("Third Wave Coffee House Bar", "Place"), ("red", "Color"), ("M&M World", "Brand")], [
            source("Globex G7 tested", "Acme Mini 3, and more; acme is great"), source(None, "glo-bex and Angel-One Pro Max: sony WH 5"), source("third wave coffee house bar", "M&M World Basic 2"), source("the best M and M World", None)], "I like Acme Mini"),
        ("b", None, None, None, None, None, None), ("c", [mention("Acme", 1)], [], [], [], [source("", "")], ""),
        ("d", [mention("Galaxy", 0), mention("Samsung", 2)], [], [], [], [source("Galaxy Fold 6", "")], "Samsung"),
    ]
    df = spark.createDataFrame(rows, "capture_id string, brand_mentions array<struct<brand:string,count:bigint>>, products array<struct<brand:string,name:string>>, places array<struct<name:string>>, entities array<struct<text:string,category:string>>, sources array<struct<title:string,snippet:string>>, answer_text string")
    got = {(r["capture_id"], r["brand"]): (r["kind"], r["sources"], r["models"]) for r in evidence.evaluated(df, {"galaxy": "Samsung"}).collect()}
    assert got == {
        ("a", "Globex"): ("omitted", [0, 1], ["G7 tested Acme Mini 3"]), ("a", "Acme"): ("ignored models", [], ["Mini 3"]), ("a", "Sony"): ("omitted", [1], ["WH 5"]), ("a", "Angel One"): ("omitted", [1], []),
        ("a", "Third Wave Coffee House Bar"): ("omitted", [2], []), ("a", "M&M World"): ("omitted", [2], ["Basic 2"]), ("d", "Samsung"): ("ignored models", [], ["Fold 6"]),
    }


def test_words_of_a_source_are_found_once_for_all_names(spark):
    """Inside the lambda over the vocabulary nothing that depends on the text alone is computed again."""
    plan = str(evidence.spoken_of(F.col("text"), F.col("known")))
    assert plan.count("translate(text") == 1 and "sequence(" not in plan
    df = spark.createDataFrame([("xa b ab ab y", ["abab"]), ("a b c d e f", ["abcde", "abcd", "ab", "bcde", "cdef"]), ("a&b cd", ["bcd", "abcd", "acd"]), ("KELVIN sign, glo-bex", ["kelvinsign", "signglo", "globex", "lobex"])], "text string, keys array<string>")
    got = df.select("text", evidence.spoken_of(F.col("text"), F.transform("keys", lambda k: F.struct(k.alias("key"), k.alias("name")))).alias("k")).collect()
    assert [[v["key"] for v in r["k"]] for r in got] == [["abab"], ["abcd", "ab", "bcde", "cdef"], [], ["kelvinsign", "signglo", "globex"]]


def test_trim_takes_every_blank(spark):
    from answerscope.functions import text as T

    blanks = "".join(c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and (c in " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" or 0x2000 <= ord(c) <= 0x200A))
    df = spark.createDataFrame([(f"{blanks}a{blanks}b{blanks}",), (blanks,), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.js_trim(F.col("x"))).collect()] == [f"a{blanks}b", "", "", None]
    assert "regexp" not in str(T.js_trim(F.col("x")))


def test_segments_cover_the_text(spark):
    rng = random.Random(8)
    texts = [(k, "".join(rng.choice("abc é") for _ in range(rng.choice([0, 1, 30, 90])))) for k in range(25)] + [(98, None), (99, "whole")]
    rows = []
    for k, t in texts[:-2]:
        for _ in range(rng.randrange(9) if t else 0):
            a = rng.randrange(len(t))
            rows.append((k, a, min(len(t), a + rng.randrange(1, 25)), rng.choice(["map", "cite"])))
    df = segments.cover(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(rows, "id int, start int, end int, type string"), ["id"])
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["start"])):
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["type"], r["value"]))
    for k, t in texts:
        want, at = [], 0
        for s in sorted(x[1:] for x in rows if x[0] == k):
            if s[0] >= at:
                want += [(at, s[0], "text")] * (s[0] > at) + [s]
                at = s[1]
        want += [(at, len(t or ""), "text")] * (at < len(t or ""))
        assert [x[:3] for x in got.get(k, [])] == want and "".join(x[3] for x in got.get(k, [])) == (t or "")


def test_tables_bold_leads_and_headings(spark):
    from answerscope.operators import structure

    rng = random.Random(12)
    line = lambda: rng.choice(["| a | b |", "|---|:-:|", "| x \\| y | z |", "|---|", "", "  ", "plain", "| **Acme** X | 2 |", "c | d", "--- | ---", "|", "## Zed — Best", "### 3. Kreo: Harpy", "# Top", "- **Foo: Bar** is", "1. **Baz**", "x **no**", "🥇 **Q**", "## " + "long " * 12, "### For A → Bolt", "**:**"])
    texts = [(k, "\n".join(line() for _ in range(rng.randrange(14)))) for k in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    rows = structure.table_rows(structure.text_lines(df, ["id"]), ["id"]).orderBy("id", "line").collect()
    got = structure.candidates(df, ["id"]).orderBy("id", "line").collect()
    for k, t in texts:
        assert [r["cells"][0] for r in rows if r["id"] == k and r["cells"][0]] == brands.table_cells(t or ""), t
        assert [r["candidate"] for r in got if r["id"] == k and r["kind"] == "table"] == [c for c in map(brands.clean_candidate, brands.table_cells(t or "")) if c], t
    kinds = lambda t: [(r["kind"], r["candidate"]) for r in structure.candidates(spark.createDataFrame([(1, t)], "id int, text string"), ["id"]).orderBy("line", "kind").collect()]
    assert kinds("## Zed — Best\n### 3. Kreo: Harpy\n- **Foo: Bar** is\n1. **Baz**\n# Top\nx **no**\n### For A → Bolt\n### **V70**") == [("heading", "Zed"), ("heading", "Harpy"), ("bold", "Bar"), ("bold", "Baz"), ("heading", "Bolt"), ("bold", "V70")]


def test_footnotes(spark):
    from answerscope.operators import footnotes
    from answerscope.sources import exports

    o, m, c = brands.OPEN, brands.MID, brands.CLOSE
    cite = lambda *ids: f"{o}cite{m}{m.join(ids)}{c}"
    rng = random.Random(3)
    ids = [f"turn0search{k}" for k in range(5)] + ["turn1news0"]
    rows = []
    for k in range(60):
        sources = [(f"https://s{rng.randrange(4)}.com/", rng.sample(ids[:4], rng.randrange(3))) for _ in range(rng.randrange(5))]
        text = "".join(rng.choice(["é words ", "", "x", cite(*rng.sample(ids, rng.randrange(1, 4)))]) for _ in range(rng.randrange(9)))
        rows.append((k, text or "none", list({u: (u, i) for u, i in sources}.values())))
    df = spark.createDataFrame(rows, "capture_id int, answer_text string, sources array<struct<url:string,marker_ids:array<string>>>")
    got = {r["capture_id"]: r for r in footnotes.footnoted(df).collect()}
    for k, text, sources in rows:
        want = exports.footnotes(text, [{"url": u, "marker_ids": i} for u, i in sources])
        assert (got[k]["text"], got[k]["notes"], got[k]["unresolved"], got[k]["others"]) == (want["text"], want["notes"], want["unresolved"], want["others"]), text


def test_candidates_read_the_texts_once(spark):
    """Tables, bold leads and headings come from one pass over the lines; texts were written and split once a kind before."""
    from answerscope.operators import structure

    df = spark.createDataFrame([(1, "| A | B |\n|--|--|\n| **x** | y |\n## Z — q\nplain\n| c | d |")], "id int, text string").repartition(3, "id")
    out = structure.candidates(df, ["id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert sorted((r["kind"], r["line"], r["candidate"]) for r in out.collect()) == [("heading", 3, "Z"), ("table", 2, "x")]


def test_footnotes_need_no_shuffle(spark):
    from answerscope.functions.brands import CLOSE, MID, OPEN
    from answerscope.operators import footnotes

    cite = lambda *m: f"{OPEN}cite{''.join(MID + x for x in m)}{CLOSE}"
    rows = [(1, f"a{cite('turn0search1', 'turn9x9')} b{cite('turn0search2')}{cite('turn0search1')}", [("u1", ["turn0search1"]), ("u2", ["turn0search1", "turn0search2"]), ("u3", None), ("u1", [])]), (2, "", []), (3, None, None), (4, "x", None)]
    df = spark.createDataFrame(rows, "capture_id long, answer_text string, sources array<struct<url:string,marker_ids:array<string>>>")
    out = footnotes.footnoted(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r["capture_id"]: tuple(r)[1:] for r in out.collect()} == {1: ("a[1] b[1][1]", ["u2"], ["turn9x9"], ["u1", "u3"]), 4: ("x", [], [], [])}
