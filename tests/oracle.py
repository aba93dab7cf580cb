"""Compares a query with its SQL oracle, as multisets of rows by column name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_value(r[k]) for k in order) for r in data), key=repr)


def compare(df, con, sql):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows(names, got.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(have) == len(want), (len(have), len(want))
    bad = [(a, b) for a, b in zip(have, want) if a != b]
    assert not bad, bad[:3]
    return len(have)
