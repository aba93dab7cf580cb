import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from answerscope.llm import queries as Q
from answerscope.llm import simhash


def plain_fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reach(ids, bits, radius):
    """Smallest id that each row reaches, by comparing everything with everything."""
    bits, least = np.array(bits, np.uint64), np.array(ids, np.int64)
    pairs = [np.flatnonzero(np.bitwise_count(bits ^ x) <= radius) for x in bits]
    while True:
        new = np.array([least[p].min() for p in pairs])
        if (new == least).all():
            return new.tolist()
        least = new


def found(spark, rows, radius=2):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df, 3, radius).collect()}


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text("aBÉ \t\n\x1f#", max_size=60), st.lists(st.sampled_from(["a", "B", "straße", "ß9"]), max_size=30).map(" ".join)))
def test_fingerprint_is_the_majority_of_the_hashes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_in_portions(monkeypatch):
    text = " ".join(random.Random(1).choice("abcdef") for _ in range(5000))
    monkeypatch.setattr(simhash, "AT_ONCE", 700)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
@pytest.mark.parametrize("lanes", [1 << 15, 16])
def test_bit_sliced_pairs_equal_plain_distances(monkeypatch, radius, lanes):
    monkeypatch.setattr(simhash, "LANES", lanes)
    rng = random.Random(radius)
    near = lambda x: x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, radius + 3)))
    sizes, bits = [1, 2, 130, 1, 64, 3, 200, 5], []
    for s in sizes:
        base = [rng.getrandbits(64) for _ in range(1 + s // 40)]
        bits += [near(rng.choice(base)) for _ in range(s)]
    bounds = np.cumsum([0, *sizes])
    start, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    bits = np.array(bits, np.uint64)
    got = {(int(a), int(b)) for x, y in simhash.within(bits, start, end, radius) for a, b in zip(x, y, strict=True)}
    assert got == {(a, b) for a in range(len(bits)) for b in range(a + 1, end[a]) if (int(bits[a]) ^ int(bits[b])).bit_count() <= radius}
    a, b = simhash.spanning(len(bits), simhash.within(bits, start, end, radius))
    assert len(a) < len(bits) and reach(range(len(bits)), bits, radius) is not None
    parts = {k: k for k in range(len(bits))}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert parts[x] != parts[y]  # a forest
        old, new = max(parts[x], parts[y]), min(parts[x], parts[y])
        parts = {k: new if v == old else v for k, v in parts.items()}
    assert all(parts[x] == parts[y] for x, y in got)


@pytest.mark.parametrize("block", [4096, 16, 4])
def test_every_close_pair_shares_a_block(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)] + [0]
    bits = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 4))) for b in base for _ in range(12)} | {1 << k for k in range(64)} | {(1 << 64) - 1}
    signed = [int(np.uint64(x).astype(np.int64)) for x in bits]
    rows = simhash.blocks(spark.createDataFrame([(x,) for x in signed], "bits long"), 2).collect()
    groups = {}
    for r in rows:
        assert r["mask"] & r["bits"] == r["value"]
        groups.setdefault((r["mask"], r["value"]), set()).add(r["bits"])
    assert all(2 <= len(g) <= block for g in groups.values())
    want = {(x, y) for x in signed for y in signed if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    assert want <= {(x, y) for g in groups.values() for x in g for y in g if x < y}


def corpus():
    """Short texts, whose fingerprints move by few bits, in groups of copies and chains, and unrelated ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(25):
        t = [word() for _ in range(400)]
        for _ in range(8):
            t = list(t)
            t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += ["Same text of a hot group of copies"] * 120 + [word() for _ in range(60)] + ["", None, " \t"]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("radius", "block"), [(2, 4096), (2, 4), (4, 4096), (0, 4096)])
def test_components_equal_brute_force(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = corpus()
    bits = [plain_fingerprint(t) for _, t in rows]
    want = reach([i for i, _ in rows], bits, radius)
    got = found(spark, rows, radius)
    assert got == {i: (b, c) for (i, _), b, c in zip(rows, bits, want, strict=True)}
    assert len(set(want)) < len(set(bits)) or radius == 0


def test_odd_rows(spark, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["fingerprint"] for i in (4, 5, 6) for r in by[i]} == {"0" * 16} and {r["component_id"] for i in (4, 5, 6) for r in by[i]} == {4}
    assert by[2][0]["component_id"] == 1 and by[None][0]["component_id"] is None
    assert len(by[13]) == 2 and simhash.near_duplicates(empty).count() == 0


def test_a_repeated_id_does_not_join_its_texts(spark):
    rows = [(1, "one text of some words here"), (2, "another story about a dog"), (3, "one text of some words here"), (1, "another story about a dog")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=0).collect()
    assert sorted(r["component_id"] for r in got) == [1, 1, 1, 1] and len({r["fingerprint"] for r in got}) == 2


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    bits = [plain_fingerprint(t) for _, t in docs]
    want = {i: (f"{b:016x}", c) for (i, _), b, c in zip(docs, bits, reach([i for i, _ in docs], bits, 2), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.QUERIES["op12_simhash"](spark, small).collect()} == want
