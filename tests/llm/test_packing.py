import random

import numpy as np
from pyspark.sql import functions as F

from mundspark.llm.packing import Index, containers, fill_report, pack


def check(placed, items, capacity):
    """Every item whole, in one container, unless it is longer; nothing over the capacity; nothing overlaps."""
    used, pieces = {}, {}
    for r in placed:
        if r.container is None:
            continue
        used.setdefault(r.container, []).append((r.at, r.length, r.owner))
        pieces.setdefault(r.id, []).append(r)
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert parts[-1][0] + parts[-1][1] <= capacity and len({p[2] for p in parts}) == 1
    for i, size in items.items():
        if size is None or size < 1:
            assert i not in pieces
        else:
            got = pieces[i]
            assert sum(r.length for r in got) == size and len(got) == max(1, -(-size // capacity)) and sorted(r.piece for r in got) == list(range(len(got)))


def test_containers(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(4000):
        size = rnd.choice([None, 0, -5, 1, 10, 99, 100, 101, 250, *[rnd.randint(5, 60) for _ in range(30)]])
        rows.append((i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, *[f"o{k}" for k in range(50)]]), size, rnd.choice([None, "", " ".join(rnd.choice("abcdefgh") for _ in range(6))])))
    df = spark.createDataFrame(rows, "id long, who string, size long, said string").withColumn("container", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("terms", F.lit(2))
    placed = containers(df, "id", F.col("who"), F.col("size"), F.col("said"), 100)
    got = placed.collect()
    assert {r.id for r in got} == {r[0] for r in rows}
    check(got, {r[0]: r[2] for r in rows}, 100)
    f = fill_report(placed, 100).first()
    assert f.containers <= 1.15 * f.least_containers
    assert containers(df.limit(0), "id", F.col("who"), F.col("size"), F.col("said"), 100).count() == 0


def test_index_scores_as_bm25():
    docs = [[1, 2, 3], [2, 2, 4], [9], [], [1, 2]]
    idf = np.array([0.0, 1.5, 0.5, 2.0, 1.0, 0, 0, 0, 0, 3.0])
    ix = Index(docs, idf, 2.0)

    def score(q, d):
        return sum(idf[t] * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / 2.0)) for t in set(q) if t in d)

    got = ix.neighbours(0, [False, True, True, True, True])
    assert got == sorted((i for i in range(1, 5) if score(docs[0], docs[i]) > 0), key=lambda i: -score(docs[0], docs[i]))


def test_pack_prefers_neighbours_and_fills():
    boxes = pack([20, 20, 20, 20], [[1, 2], [3, 4], [1, 2], [3, 4]], 40, np.ones(10), 2.0)
    assert sorted(map(sorted, boxes)) == [[0, 2], [1, 3]]
    assert sorted(map(len, pack([60, 40, 50, 30, 20], [[], [], [], [], []], 100, np.ones(10), 1.0))) in ([2, 3], [1, 2, 2])
    assert pack([], [], 10, np.ones(1), 1.0) == []


def test_fill_report_counts_items_without_a_place(spark):
    rows = [("a", "c1", 60), ("a", "c1", 30), ("a", None, None), ("b", None, None), (None, None, None), ("b", "c2", 100)]
    f = fill_report(spark.createDataFrame(rows, "owner string, container string, length long"), 100).first()
    assert (f.containers, f.used, f.unused, f.least_containers, f.unplaced) == (2, 190, 10, 2, 3)
