import random

from pyspark.sql import functions as F

from mundspark.llm.components import components, grouped_split, same_speaker_pairs


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    for n, m in ((60, 40), (200, 260), (1, 0)):
        edges = [(str(rnd.randrange(n)), str(rnd.randrange(n))) for _ in range(m)] + [(str(i), str(i + 1)) for i in range(1000, 1000 + n)] + [("x", None)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if b is not None and a != b:
                root[find(a)] = find(b)
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
        assert set(got) == set(root)
        for x in root:
            assert got[got[x]] == got[x]
        groups = lambda f: sorted(sorted(x for x in root if f(x) == c) for c in {f(x) for x in root})
        assert groups(lambda x: got[x]) == groups(find)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_speakers_and_splits(spark):
    h = "0123456789abcdef"
    rows = [(i, c, "d") for i, c in enumerate([h, "{" + h.upper() + "}", "spk_" + h, None, "", " ", "bob", h] + [f"{i:016x}" for i in range(400)] * 3 + ["f" * 16] * 500)]
    df = spark.createDataFrame(rows, "id long, client_id string, set string").withColumn("component", F.lit(1)).withColumn("unit", F.lit(2))
    got = sorted(tuple(r) for r in same_speaker_pairs(df).collect())
    ids = sorted([h, "{" + h.upper() + "}", "spk_" + h])
    assert got == [(ids[0], ids[1]), (ids[0], ids[2]), (ids[1], ids[2])]
    s = grouped_split(df, "id", "client_id", {"set": F.col("set"), "none": F.lit(None).cast("string")}, {"train": 0.8, "valid": 0.1, "test": 0.1})
    out = {r.id: (r.split, r.component) for r in s.collect()}
    assert len(out) == len(rows)
    assert len({out[i][0] for i in (0, 1, 2, 7)}) == 1
    by = {}
    for split, c in out.values():
        assert by.setdefault(c, split) == split
    share = {x: sum(v[0] == x for v in out.values()) / len(rows) for x in ("train", "valid", "test")}
    assert abs(share["valid"] - 0.1) < 0.02 and abs(share["test"] - 0.1) < 0.02
    assert grouped_split(df.limit(0), "id", "client_id", {"set": F.col("set")}, {"train": 0.8, "valid": 0.2}).count() == 0


def test_small_strata_are_split_fairly(spark):
    """18 records of 6 speakers: each split has some; and a speaker with a third of a stratum goes to training."""
    rows = [(i, f"{i // 3:016x}", "s") for i in range(18)] + [(100 + i, f"{100 + (i // 2 if i >= 100 else 0):016x}", "big") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, client_id string, set string")
    out = {r.id: r.split for r in grouped_split(df, "id", "client_id", {"set": F.col("set")}, {"train": 0.8, "valid": 0.1, "test": 0.1}).collect()}
    count = lambda ids: [sum(out[i] == x for i in ids) for x in ("train", "valid", "test")]
    assert count(range(18)) == [12, 3, 3]
    assert out[100] == "train" and all(abs(n - w) <= 2 for n, w in zip(count(range(100, 400)), (240, 30, 30)))
