from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.operators import features, models


def test_probe_and_perceptron(spark):
    rows = [(i, [float(i % 3), float((i * 7) % 5)], i % 3) for i in range(90)] + [(900, None, 1), (901, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "k int, v array<double>, l int")
    s = models.probe(df, "v", "l", "k", k=3).first()
    assert s.n == 90 and s.accuracy > 0.95
    m = models.perceptron(df, "v", "l", "k", 2, 3, (8,), 200)
    assert m.transform(models.vectors(df, "v", "l", "k")).where("prediction = label").count() > 80


def test_benchmark(spark):
    df = spark.createDataFrame([(i, f"wort {i}", f"wort {i}", i % 2) for i in range(10)], "k int, audio string, ref string, l int")

    def good():
        return lambda xs: list(xs)

    def bad():
        def model(xs):
            if any(x.endswith("3") for x in xs):
                raise RuntimeError("broken")
            return ["wort"] * len(xs)

        return model

    p, s = models.benchmark(df, {"good": good, "bad": bad}, "k", "audio", "ref", "l", per_label=4)
    got = {(r.model, r.label): r for r in s.collect()}
    assert got["good", 0].wer == 0 and got["good", 0].pairs == 4 and got["bad", 0].wer == 0.5 and got["bad", 0].failed == 0
    assert p.count() == 16 and sum(r.failed for r in got.values()) == p.where("reason is not null").count()


def test_blocks_and_rules(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "k int, v array<double>")
    b = spark.createDataFrame([(2, [5.0, 6.0])], "k int, w array<double>")
    assert [tuple(r) for r in models.blocks({"a": (a, "v"), "b": (b, "w")}, "k").collect()] == [(2, [2.0, 5.0, 6.0])]
    d = spark.createDataFrame([(0.5, 0.4), (0.4, 0.5)], "m double, d double")
    assert [tuple(r) for r in d.select(C.decision(F.col("m"), F.col("d"), "mean"), C.decision(F.col("m"), F.col("d"), "median")).collect()] == [(1, 0), (0, 1)]
    assert d.select(C.real_time_factor(F.col("m"), F.lit(0.0))).first()[0] is None
    p = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.8), (3, 1, 0.3), (1, 0, 0.8)], "doc int, label int, p double")
    g = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "doc int, group string")
    r = features.probability_summary(p, g).first()
    assert (r.docs, r.median, r.most) == (3, 0.3, 0.8)
