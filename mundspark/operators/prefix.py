"""The first n rows of each group in a total order, without sorting a group in one task.

A group may hold any share of the rows. Its rows are counted in BUCKETS buckets of an order value in [0, 1); a running
sum over the (group, bucket) table, which has at most BUCKETS rows a group, tells which buckets lie wholly inside the
first n, and only the one bucket on the boundary is ranked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mundspark.runtime import staged

BUCKETS = 4096


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A value in [0, 1) from a hash of the columns; the same on every run and in any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def running_before(df: DataFrame, group: list[str], order: str, tie: str, size: str, out: str) -> DataFrame:
    """df with the sum of `size` over the rows of the same group that come before a row by (order, tie); order is a
    value in [0, 1), the group columns are never NULL."""
    b = df.withColumn("_b", F.least(F.floor(F.col(order) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = b.groupBy(*group, "_b").agg(F.sum(size).alias("_s"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_b").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    return b.join(sums, [*group, "_b"]).select(*df.columns, (F.col("_in") + F.col("_before")).alias(out))


def first_n(df: DataFrame, group: list[str], order: str, tie: str, quota: DataFrame, n: str) -> DataFrame:
    """The first quota.n rows of each group by (order, tie). quota: one row a group, with the group columns (no NULL)
    and n. A group without a quota gives no rows; one with fewer rows than n gives them all."""
    b = df.withColumn("_b", F.least(F.floor(F.col(order) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).join(quota.select(*group, n), group)
    # the boundary bucket of each group and how many rows of it belong to the first n; buckets below it do wholly
    partial = (F.col("_before") < F.col(n)) & (F.col("_before") + F.col("_c") > F.col(n))
    cut = F.coalesce(F.min(F.when(F.col("_before") + F.col("_c") > F.col(n), F.col("_b"))), F.lit(BUCKETS))
    plan = counts.groupBy(*group).agg(cut.alias("_cut"), F.coalesce(F.max(F.when(partial, F.col(n) - F.col("_before"))), F.lit(0)).alias("_rest"))
    j = b.join(staged(plan, "quota"), group).where("_b < _cut or (_b = _cut and _rest > 0)")
    rank = Window.partitionBy(*group, "_b").orderBy(order, tie)
    edge = j.where("_b = _cut").withColumn("_r", F.row_number().over(rank)).where("_r <= _rest")
    return j.where("_b < _cut").select(*df.columns).unionByName(edge.select(*df.columns))
