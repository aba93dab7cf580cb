import random
from itertools import permutations

import pytest

from answerscope.llm import filter_audit
from answerscope.llm import queries as Q
from tests.oracle import compare, connect

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """Applies the filters one after the other to lists of rows, under every order."""
    firsts = {}
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    found = []
    for i, t, part in rows:
        t = t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 2 * len(set(w)) < len(w), "C": 50 * sum("A" <= c <= "Z" for c in t) > len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > firsts[t]}
        of = [x for x in labels if x[0] == i and i is not None]
        found.append((part or "", fails, any(q == 1 for _, q, _ in of), any(x == 1 for _, _, x in of)))
    out = {}
    for part in {x[0] for x in found}:
        mine, total = [x for x in found if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fail = sum(x[1][f] for x in mine)
                total[f] += len(gone)
                out[part, order, k] = [len(left), len(gone), fail - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def audited(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in filter_audit.audit(df, labels).collect()}


def test_first_failures_are_the_steps_of_the_first_failing_letter():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for fails in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            steps = [s for s, x in enumerate(order) if fails >> "ABCDE".index(x) & 1]
            assert table[fails, k] == min(steps, default=5)


@pytest.mark.parametrize("parts", [1024, 2])
def test_audit_equals_applying_the_filters(spark, monkeypatch, parts):
    monkeypatch.setattr(filter_audit, "PARTS", parts)
    rng = random.Random(3)
    words = ["alpha", "Beta", "c#", "dog", "EEL", "fox"] + [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words[: rng.choice([6, 12, 406])]) for _ in range(rng.choice([0, 3, 180, 199, 200, 201, 420]))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, "", "é"])) for i in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(150), 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert audited(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == brute(rows, labels)


def test_odd_rows(spark, odd, empty, labels):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.select("doc_id", "text", "source").collect()]
    assert audited(odd, labels) == brute(rows, [tuple(r) for r in labels.collect()])
    assert filter_audit.audit(empty, labels).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(odd, labels.where("false")).collect()} == {0}


def test_edges_of_the_conditions():
    bits = lambda t: {x for k, x in enumerate("ABCDE") if filter_audit.failures(t) >> k & 1}
    distinct = [f"w{k}" for k in range(200)]
    assert bits(" ".join(distinct)) == set()
    assert bits(" ".join(distinct[:199])) == {"A"}
    assert bits(" ".join(distinct[:100] + ["w0"] * 100)) == set()  # exactly half
    assert bits(" ".join(distinct[:100] + ["w0"] * 101)) == {"B"}
    assert bits("\x0b".join(distinct) + "\x1f$") == {"D"}
    assert bits("A" + "é" * 49) == {"A"} and bits("A" + "é" * 48) == {"A", "C"}


def test_query_equals_sql(spark, small):
    assert compare(Q.QUERIES["op13_filter_audit"](spark, small), connect(small), Q.ORACLES["op13_filter_audit"]) > 0
