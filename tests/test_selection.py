import math
import random

from pyspark.sql import functions as F

from mundspark.functions import arrays as A
from mundspark.operators import errors, selection


def test_top_and_bottom_ties(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 0.0), (None, "d", 2.0)], "g string, k string, s double")
    got = {(r.g, r.side, r["rank"]): r.k for r in selection.top_and_bottom(df, "g", "s", "k", 2).collect()}
    assert got == {("g", "top", 1): "a", ("g", "top", 2): "b", ("g", "bottom", 1): "c", ("g", "bottom", 2): "a", (None, "top", 1): "d", (None, "bottom", 1): "d"}


def test_uncertain_and_information(spark):
    df = spark.createDataFrame([(1, 0.9, "x"), (2, 0.45, "y"), (3, None, "x"), (4, 0.6, None)], "k int, p double, l string")
    assert [r.k for r in selection.most_uncertain(df, "p", "k", 2).collect()] == [2, 4]
    same = spark.createDataFrame([(i % 2, i % 2) for i in range(10)], "a int, b int")
    assert abs(selection.mutual_information(same, F.col("a"), F.col("b")).first()[0] - math.log(2)) < 1e-12
    assert selection.mutual_information(same.limit(0), F.col("a"), F.col("b")).first()[0] == 0.0


def test_anova(spark):
    df = spark.createDataFrame([([1.0, 5.0], 0), ([2.0, 5.0], 0), ([5.0, 5.0], 1), ([7.0, 5.0], 1), ([1.0, 1.0], None)], "v array<double>, l int")
    got = {r.dim: r.f for r in selection.anova(df, "v", "l").collect()}
    # means 1.5 and 6 around 3.75; squares within 0.5 and 2
    assert abs(got[0] - (2 * 2 * 2.25**2 / 1) / (2.5 / 2)) < 1e-9 and got[1] is None


def test_coverage_and_pairs(spark):
    a, b = (spark.createDataFrame(x, "k string") for x in ([("x",), ("x",), ("y",), (None,)], [("y",), ("z",), (None,)]))
    assert tuple(selection.coverage(a, b, "k").first()) == (2, 2, 1, 1, 1)
    c, d = spark.createDataFrame([("/a/x.wav",), ("/a/y.wav",)], "w string"), spark.createDataFrame([("/a/x.txt",)], "t string")
    assert [tuple(r) for r in selection.paired(c, d, "w", "t").collect()] == [("/a/x.wav", "/a/x.txt")]


def test_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "v array<int>")
    one = lambda c: [r[0] for r in df.select(c).collect()]
    v = F.col("v")
    assert one(A.bounded(v, 1, 2, 4)) == [[1, 5, 6, 2], [1, 2]]
    assert one(A.padded(v, 5)) == [[5, 6, 7, 0, 0], [0] * 5] and one(A.padded(v, 2)) == [[5, 6], [0, 0]]
    assert one(A.targets(v, 5, 1)) == [[-100, 7, -100, -100, -100], [-100] * 5]
    assert one(A.inside(A.bounded(v, 1, 2, 9), 1, 2)) == [[5, 6, 7], []] and one(A.inside(v, 1, 2)) == [[5, 6, 7], []]


def test_moves(spark):
    assert errors.translation_edits("a b c d e".split(), "c d e a b".split()) == 1
    assert errors.translation_edits("a b".split(), []) == 2 and errors.translation_edits([], ["x"]) == 1
    rnd = random.Random(1)
    for _ in range(100):
        r, h = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        assert errors.translation_edits(r, h) <= errors._edits(r, h)
    df = spark.createDataFrame([("g", "a b c d", "c d a b"), ("g", None, None), ("h", "a b", "a x")], "g string, r string, h string")
    assert {r.g: r.ter for r in errors.translation_edit_rate(df, "r", "h", "g").collect()} == {"g": 25.0, "h": 50.0}
