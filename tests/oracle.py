"""Runs a query and its SQL and compares the rows, as the driver does."""

import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf=SF):
    c = duckdb.connect()
    c.execute("set threads = 4")
    c.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        name, path = f.removesuffix(".parquet"), f"{sf}/{f}"
        c.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, name, sf=SF):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf)
    cur = connect(sf).execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    order = sorted(cols)
    pick = [cols.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in pick) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[df[f"`{c}`"] for c in order]).collect()), key=repr)
    assert len(got) == len(want), f"{name}: {len(got)} rows, SQL has {len(want)}"
    extra, lost = Counter(got) - Counter(want), Counter(want) - Counter(got)
    assert not extra and not lost, f"{name}: of {len(got)} rows {sum(extra.values())} differ: {list(extra)[:4]} for {list(lost)[:4]}"
    return len(got)
