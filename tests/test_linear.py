"""The linear model against Spark's own, and how its rows are packed."""

import random

import numpy as np
from pyspark.sql import functions as F

from mundspark.operators import features, linear

N = 64


def counts(spark, docs=300, seed=1):
    r = random.Random(seed)
    rows = [(d, t, r.randint(1, 4)) for d in range(docs) for t in r.sample(range(d % 3 * 20, d % 3 * 20 + 60), r.randint(1, 12))]
    labels = spark.createDataFrame([(d, (d % 3 if r.random() < 0.8 else r.randrange(3)) + 2 * (d % 3 == 2), d % 5 == 0) for d in range(docs)], "doc long, label int, held boolean")
    return spark.createDataFrame(rows, "doc long, term long, tf long"), labels


def unpacked(blobs):
    """(held, label, {slot: value}) of every row."""
    out = []
    for b in blobs.collect():
        slots, values, at = np.frombuffer(b.slots, np.int32), np.frombuffer(b.values, np.float32), 0
        for y, n in zip(np.frombuffer(b.labels, np.int32), np.frombuffer(b.sizes, np.int32)):
            out.append((b.held, int(y), dict(zip(slots[at : at + n].tolist(), values[at : at + n].tolist()))))
            at += n
    return out


def test_rows_are_packed_whole(spark, monkeypatch):
    c, labels = counts(spark)
    vocab = features.vocabulary(c)
    known = features.tfidf(c, vocab, 300)
    want = []
    slot = F.pmod(F.xxhash64("t.term"), F.lit(N)).cast("int")
    for r in known.select("doc", F.explode("terms").alias("t")).groupBy("doc", slot.alias("slot")).agg(F.sum("t.weight").alias("v")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("x")).join(labels, "doc").collect():
        want.append((r.held, r.label, {k: round(v, 5) for k, v in sorted(r.x.items())}))
    monkeypatch.setattr(linear, "ENTRIES", 40)
    blobs = features.hashed_rows(c, vocab, 300, labels, N)
    got = [(h, y, {k: round(v, 5) for k, v in sorted(x.items())}) for h, y, x in unpacked(blobs)]
    flat = lambda rows: sorted((h, y, sorted(x)) for h, y, x in rows)
    assert flat(got) == flat(want)
    for a, b in zip(*(sorted(rows, key=lambda r: (r[0], r[1], sorted(r[2].items()))) for rows in (got, want))):
        assert max(abs(a[2][k] - b[2][k]) for k in b[2]) < 1e-4
    whole = [b for b in features.hashed_rows(c, vocab, 300, labels, N).collect()]
    assert max(len(b.sizes) for b in whole) >= 4 and all(len(b.slots) == len(b.values) for b in whole)


def test_same_as_sparks_regression(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    c, labels = counts(spark)
    blobs = features.hashed_rows(c, features.vocabulary(c), 300, labels, N).cache()
    n = features.label_counts(labels.where("not held"))
    assert sorted(n) == [0, 1, 2, 3, 4]
    model = features.linear_model(blobs.where("not held"), n, N, 0.01)
    at = {x: i for i, x in enumerate(sorted(n))}
    rows = [(float(at[y]), SparseVector(N, x), sum(n.values()) / (len(n) * n[y])) for h, y, x in unpacked(blobs) if not h]
    df = spark.createDataFrame(rows, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT()), StructField("w", DoubleType())]))
    theirs = LogisticRegression(weightCol="w", maxIter=100, regParam=0.01, tol=1e-9).fit(df)
    x = np.array([r[1].toArray() for r in rows])
    softmax = lambda m: np.exp(m - m.max(1, keepdims=True)) / np.exp(m - m.max(1, keepdims=True)).sum(1, keepdims=True)
    ours = softmax(x @ model.coefficients + model.intercepts)
    assert np.abs(ours - softmax(x @ theirs.coefficientMatrix.toArray().T + theirs.interceptVector.toArray())).max() < 0.005
    got = model.predict(blobs.where("held")).collect()
    assert len(got) == sum(h for h, _, _ in unpacked(blobs)) and {r.prediction for r in got} <= set(n)


def test_rows_never_become_objects(spark):
    """A batch of long rows in one worker: as rows of Python objects it took gigabytes."""
    c = spark.range(2000).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(499))).alias("k")).select("doc", ((F.col("doc") * 7 + F.col("k")) % 1000).alias("term"), F.lit(1).cast("long").alias("tf"))
    labels = spark.range(2000).select(F.col("id").alias("doc"), (F.col("id") % 2).cast("int").alias("label"), F.lit(False).alias("held"))
    blobs = features.hashed_rows(c, features.vocabulary(c), 2000, labels)
    plan = blobs._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    sizes = [len(b.slots) // 4 for b in blobs.collect()]
    assert sum(sizes) == 2000 * 500 or sum(sizes) > 2000 * 490  # some terms collide
    assert max(sizes) <= linear.ENTRIES
