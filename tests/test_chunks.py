import random

import pytest
from pyspark.sql import functions as F

from mundspark.operators.chunks import block_table, chain, cycled, greedy_chunks, walk


def plain(sizes, target, policy):
    out, chunk, total = [], -1, None
    for d in sizes:
        if total is None or (total + d > target if policy == "pre" else total >= target):
            chunk, total = chunk + 1, 0.0
            total = d
        else:
            total += d
        out.append(chunk)
    return out


@pytest.mark.parametrize("policy", ["pre", "post"])
def test_walk_and_blocks(policy):
    rnd = random.Random(1)
    for _ in range(300):
        sizes = [rnd.choice([0.0, 0.1, 1.0, 2.5, 7.0, 30.0]) for _ in range(rnd.randint(1, 60))]
        target = rnd.choice([1.0, 5.0, 10.0])
        want = plain(sizes, target, policy)
        assert [x - 1 for x in walk(sizes, target, policy)[0]] == want
        cuts = sorted({0, *rnd.sample(range(len(sizes)), min(4, len(sizes)))})
        parts = [sizes[a:b] for a, b in zip(cuts, [*cuts[1:], len(sizes)])]
        blocks = [(i, *block_table(p, target, policy)) for i, p in enumerate(parts)]
        got = []
        for (i, inherited, before), p in zip(chain(blocks, target, policy), parts):
            got += [before + x - 1 for x in walk(p, target, policy, inherited)[0]]
        assert got == want


@pytest.mark.parametrize("policy", ["pre", "post"])
def test_large_keys_are_cut_into_blocks(spark, policy):
    rnd = random.Random(2)
    rows = [("hot", i, rnd.choice([0.0, 0.5, 3.0, 12.0])) for i in range(3000)]
    rows += [(k, i, float(rnd.randint(1, 9))) for k in ("a", None) for i in range(20)] + [("null", 0, None)]
    df = spark.createDataFrame(rows, "k string, o long, d double")
    got = {(r.k, r.o): r.chunk for r in greedy_chunks(df, ["k"], ["o"], F.col("d"), 10.0, policy, block=100).collect()}
    assert len(got) == len(rows)
    for k in ("hot", "a", None, "null"):
        mine = sorted((o, d or 0.0) for x, o, d in rows if x == k)
        assert [got[k, o] for o, _ in mine] == plain([d for _, d in mine], 10.0, policy)


def test_borders_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 20.0), ("a", 4, 1.0)], "k string, o int, d double")
    assert [r.chunk for r in greedy_chunks(df, ["k"], ["o"], F.col("d"), 10.0).orderBy("o").collect()] == [0, 0, 1, 2]
    assert [r.chunk for r in greedy_chunks(df, ["k"], ["o"], F.col("d"), 10.0, "post").orderBy("o").collect()] == [0, 0, 1, 2]
    assert greedy_chunks(df.limit(0), ["k"], ["o"], F.col("d"), 10.0).count() == 0
    with pytest.raises(ValueError):
        greedy_chunks(df, ["k"], ["o"], F.col("d"), 0.0)


def test_cycled(spark):
    rows = [("short", 1, 2.0, "x"), ("short", 2, 0.0, "y"), ("none", 1, 0.0, "p"), ("none", 2, None, "q"), ("long", 1, 6.0, "u"), ("long", 2, 6.0, "v")]
    df = spark.createDataFrame(rows, "k string, o int, d double, t string")
    got = {(r.k, r.chunk): r.document for r in cycled(df, ["k"], ["o"], F.col("d"), "t", 10.0).collect()}
    assert got["short", 0] == "x y x y"  # 2 + 5 + 2 + 5 reaches 10
    assert got["none", 0] == " ".join(["p", "q"] * 6)
    assert got["long", 0] == "u" and got["long", 1] == "v"
