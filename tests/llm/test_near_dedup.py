import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from answerscope.llm import near_dedup
from answerscope.llm._common import components


def brute(rows, words, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        common = Counter()
        for s in sets[i]:
            common.update(holders[s])
            holders[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in sets}


def near(spark, rows, words, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, words, percent).collect()}


@pytest.fixture(scope="module")
def corpus():
    """A large group of near copies of varied distance, chains, small groups and unrelated texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    rows, base = [], text(150)
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    for _ in range(15):
        t = text(80)
        for _ in range(4):  # a chain: each changes the one before
            t = list(t)
            t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [" ".join(text(60)) for _ in range(100)] + [rows[0].upper()] * 40 + ["", "one", "one", "one two", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(spark, corpus, words, percent):
    assert near(spark, corpus, words, percent) == brute(corpus, words, percent)


@pytest.mark.parametrize(("block", "size", "pivots"), [(16, 16 << 20, 4), (4096, 4000, 1)])
def test_large_groups_are_split_into_blocks(spark, corpus, monkeypatch, block, size, pivots):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    assert near(spark, corpus, 3, 85) == brute(corpus, 3, 85)


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 4096), (5, 80, 4)])
def test_chains_of_twelve(spark, monkeypatch, words, percent, block):
    """150 chains whose neighbours are just alike, in a random order of rows."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        t = [str(rng.randrange(10**6)) for _ in range(120)]
        for _ in range(12):
            t = list(t)
            t[rng.randrange(20, 100)] = str(rng.randrange(10**6))
            texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, words, percent)
    got = near(spark, rows, words, percent)
    assert got == want and len({c for _, c in want.values()}) == 150


def test_odd_rows(odd, empty):
    got = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(got) == odd.count() and near_dedup.near_duplicates(empty, 3, 85).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["component_id"] for k in (1, 2, 3)] == [1, 1, 1] and [by[k]["kept"] for k in (1, 2, 3)] == [True, False, False]
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and by[5]["kept"] and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = near_dedup.one_of_each(odd, 5, 80)
    assert kept.columns == odd.columns and kept.where("doc_id = 13").count() == 1 and kept.where("doc_id is null").count() == 1 and kept.where("doc_id in (1, 2, 3)").count() == 1


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(200)] + [(300, 301), (301, 300), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def parts_of(n, edges):
    label = list(range(n))
    for a, b in edges:
        label = [label[a] if x == label[b] else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


@pytest.mark.parametrize("links", [[(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)], [(0, 1), (2, 3), (3, 4), (4, 5)]])
@pytest.mark.parametrize("sides", [None, (0, 1, 0, 1, 0, 1)])
def test_forest_finds_all_links_in_every_order(links, sides):
    n = 1 + max(map(max, links))
    links = [(a, b) for a, b in links if sides is None or sides[a] != sides[b]]
    for order in itertools.permutations(range(n)):
        near = np.eye(n, dtype=bool)
        for a, b in links:
            near[order[a], order[b]] = near[order[b], order[a]] = True
        side = None if sides is None else np.array([sides[order.index(k)] for k in range(n)])
        edges = near_dedup._Forest(n).connect_all(lambda x, near=near: near[x], None if side is None else lambda x, side=side: side != side[x])
        assert all(near[e] for e in edges) and parts_of(n, edges) == parts_of(n, [(order[a], order[b]) for a, b in links]), order


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 14).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=2 * n), st.lists(st.booleans(), min_size=n, max_size=n))))
def test_forest_equals_union_find(case):
    """Random graphs in random orders; also with rows that are one part already."""
    n, links, joined = case
    near = np.eye(n, dtype=bool)
    for a, b in links:
        near[a, b] = near[b, a] = True
    assert parts_of(n, near_dedup._Forest(n).connect_all(lambda x: near[x])) == parts_of(n, links)
    one = np.array(joined)
    known = [(int(one.argmax()), k) for k in np.flatnonzero(one).tolist()]
    edges = near_dedup._Forest(n, one).connect_all(lambda x: near[x], lambda x: one != one[x])
    assert parts_of(n, edges + known) == parts_of(n, known + [(a, b) for a, b in links if one[a] != one[b]])


@pytest.mark.parametrize("percent", [1, 5, 12, 13, 30, 50, 70, 80, 85, 90, 99, 100])
def test_matches_keep_the_miss_bound_at_every_threshold(percent):
    coordinates, matches = near_dedup.matching(percent)
    assert 1 <= matches <= coordinates
    p = percent / 100
    drawn = np.random.default_rng(3).binomial(coordinates, p, 400_000)
    assert (drawn < matches).mean() <= 1 / 5000 + 4 * (1 / 5000 / 400_000) ** 0.5


@pytest.mark.parametrize("percent", [8, 35, 80])
def test_pairs_just_at_the_threshold_are_found(spark, percent):
    """600 pairs of texts, each as little alike as the threshold allows."""
    rows, shared = [], 400
    rest = (shared * 100 // percent - shared) // 2
    for k in range(600):
        common = [f"c{k}x{j}" for j in range(shared)]
        rows += [" ".join(common + [f"{side}{k}x{j}" for j in range(rest)]) for side in "ab"]
    got = near(spark, list(enumerate(rows)), 1, percent)
    missed = sum(got[2 * k + 1][1] != 2 * k for k in range(600))
    assert missed <= 1, missed
