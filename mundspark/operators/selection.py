"""Choosing by score: best and worst of each class, the most uncertain, how much a feature tells of a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mundspark.operators.rows import top


def top_and_bottom(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the largest and the k with the smallest score (column side: `top`, `bottom`), with
    their rank from 1; ties by key. The rank filter reaches below the shuffle, so a group sends k rows a task."""
    out = None
    for side, first in (("top", F.col(score).desc()), ("bottom", F.col(score).asc())):
        r = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(first, key))).where(F.col("rank") <= k).withColumn("side", F.lit(side))
        out = r if out is None else out.unionByName(r)
    return out


def most_uncertain(df: DataFrame, probability: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows whose probability is nearest to a half; ties by a seeded shuffle."""
    return top(df.where(F.col(probability).isNotNull()), n, [F.abs(F.col(probability) - 0.5)], key, seed)


def anova(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(dim, f): the ratio of variance between and within labels of each place of an array column, in one aggregation of
    sums; NULL where nothing varies within."""
    e = df.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    g = e.groupBy("dim", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("dim")  # one row for each label
    g = g.withColumn("_all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("dim").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_all"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return s.select("dim", ((F.col("between") / (F.col("k") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("f"))


def mutual_information(df: DataFrame, feature: Column, label: Column) -> DataFrame:
    """One row: mutual information in nats of two discrete columns, over the rows that have both."""
    c = df.select(feature.alias("a"), label.alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    every, a, b = Window.partitionBy(), Window.partitionBy("a"), Window.partitionBy("b")  # over the cells
    p = F.col("n") / F.sum("n").over(every)
    term = p * F.log(F.col("n") * F.sum("n").over(every) / (F.sum("n").over(a) * F.sum("n").over(b)))
    return c.select(term.alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("information"))


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: different keys of a, of b, of both, of only one; NULLs are no keys."""
    x, y = (t.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn(s, F.lit(1)) for t, s in ((a, "a"), (b, "b")))
    j = x.join(y, "k", "full_outer")
    return j.agg(F.count("a").alias("in_a"), F.count("b").alias("in_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def paired(a: DataFrame, b: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of a and b whose file names agree but for their type, such as a clip and its text."""
    stem = lambda c: F.regexp_replace(F.col(c), r"\.[^./]*$", "")
    return a.withColumn("_stem", stem(a_path)).join(b.withColumn("_stem", stem(b_path)), "_stem").drop("_stem")
