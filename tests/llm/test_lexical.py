import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from answerscope.llm import lexical
from answerscope.llm import queries as Q
from tests.oracle import compare, connect

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [c for _, c in counted if c]
    total, length = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in counted:
            if i is None or not c:
                continue
            m = 10 + (90 * sum(c.values()) * total) // length
            score = sum(floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, k=10, n=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
    return sorted(tuple(r) for r in lexical.search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect())


def corpus(rng, n=400):
    words = ["the", "of", "Dog", "fox9", "straße", "日本", "it's", "x-ray"] + [f"w{k}" for k in range(150)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([8, 40, 158])]) for _ in range(rng.choice([1, 5, 40])))
    docs = [(i, text()) for i in rng.sample(range(10_000), n)]
    docs += [(20_000 + k, docs[0][1]) for k in range(130)]  # ties over several blocks
    return docs, [(i, text()) for i in range(12)] + [(3, text()), (99, "!!"), (98, None), (97, "unheardof"), (96, docs[0][1])]


@pytest.mark.parametrize(("block", "at_once", "k"), [(8192, 400_000, 10), (64, 20, 10), (100, 400_000, 3), (1, 400_000, 1)])
def test_search_equals_brute_force(spark, monkeypatch, block, at_once, k):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", at_once)
    docs, items = corpus(random.Random(block), 400 if block > 1 else 60)
    assert found(spark, docs, items, k) == brute(docs, items, k)


@pytest.mark.parametrize("text", ["", None, "a\x00b", "A_b[c]`d{e}~\x7f É-ß", " ab c １２", "x" * 100_000])
def test_terms_are_the_maximal_matches(text):
    assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)


def test_slices_add_and_rank_like_numbers():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, count = int(rng.integers(1, 400)), int(rng.integers(1, 9))
        doc, term, impact = [], [], []
        for t in range(count):
            at = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            doc.append(at)
            term.append(np.full(len(at), t))
            impact.append(rng.integers(1, int(rng.choice([2, 50, 1 << 35])), len(at)))
        block = lexical.Block(np.arange(n) * 3)
        for t, used, places, bits in lexical._sliced(*map(np.concatenate, (doc, term, impact))):
            block.slices[t] = used, places, bits
        asked = sorted(set(rng.integers(0, count + 1, 5).tolist()))
        want = np.zeros(n, np.int64)
        for d, t, i in zip(doc, term, impact, strict=True):
            if t[0] in asked:
                want[d] += i
        sums = block.added(asked)
        got = [sum(int(row[d // 64] >> np.uint64(d % 64)) % 2 << b for b, row in enumerate(sums)) for d in range(n)]
        assert got == want.tolist()
        for k in (1, 4, n + 5):
            assert sorted(block.best(asked, k), key=lambda x: (-x[0], x[1])) == sorted(((int(s), 3 * d) for d, s in enumerate(want) if s), key=lambda x: (-x[0], x[1]))[:k]


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "quick FOX lang"), (2, None), (None, "fox"), (3, "repeated id <|endoftext|> s z"), (3, "word"), (3, "word")]
    assert found(spark, rows, items) == brute(rows, items)
    some = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(empty, some).count() == 0
    assert lexical.search(odd, some.where("false")).count() == 0
    assert lexical.search(odd.where("text is null"), some).count() == 0


def test_query_equals_sql(spark, small):
    assert compare(Q.QUERIES["op11_lexical_search"](spark, small), connect(small), Q.ORACLES["op11_lexical_search"]) > 0
