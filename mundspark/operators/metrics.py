"""Classification metrics from (true, predicted) pairs. The confusion table is the only thing aggregated from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring regions by label id (fixed values).
NEIGHBOURS = {0: (1,), 1: (0, 2, 4), 2: (1, 3, 4, 5, 6), 3: (2, 5, 6), 4: (1,), 5: (2, 3), 6: (2, 3)}


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n) of the rows that have both."""
    d = df.select(F.col(true).alias("true"), F.col(pred).alias("pred")).where(F.col("true").isNotNull() & F.col("pred").isNotNull())
    return d.groupBy("true", "pred").agg(F.count(F.lit(1)).alias("n"))


def normalised(cm: DataFrame) -> DataFrame:
    """(true, pred, n, share): share of the true class's rows."""
    return cm.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def per_class(cm: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every class that is true or predicted somewhere; 0 where a denominator
    is 0."""
    each = cm.select("n", F.inline(F.array(F.struct(F.col("true").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("true") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))))
    s = each.groupBy("label").agg(F.sum(F.col("t") * F.col("n")).alias("support"), F.sum(F.col("p") * F.col("n")).alias("predicted"), F.sum(F.col("hit") * F.col("n")).alias("hits"))
    p = F.coalesce(F.col("hits") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.nullif("support", F.lit(0)), F.lit(0.0))
    s = s.select("label", p.alias("precision"), r.alias("recall"), "support")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return s.withColumn("f1", f1)


def summary(cm: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1, balanced_accuracy (mean recall, classes without support count 0)."""
    c = per_class(cm)
    hits = F.sum(F.col("recall") * F.col("support"))
    return c.agg(F.sum("support").alias("n"), (hits / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"))


def neighbour_table(cm: DataFrame, neighbours: dict[int, tuple[int, ...]] = NEIGHBOURS) -> DataFrame:
    """(label, support, correct, neighbour, other, neighbour_share, chance, lift): errors with a neighbouring class and
    with others; lift is the share of errors that hit neighbours over that of a random error."""
    classes = len(neighbours)
    edges = F.create_map(*[x for k, v in neighbours.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    near = F.coalesce(F.array_contains(F.try_element_at(edges, F.col("true").cast("int")), F.col("pred").cast("int")), F.lit(False))
    kind = F.when(F.col("true") == F.col("pred"), "correct").when(near, "neighbour").otherwise("other")
    k = cm.where(F.col("true").isin(*neighbours)).withColumn("kind", kind)
    of = lambda x: F.sum(F.when(F.col("kind") == x, F.col("n")).otherwise(0)).alias(x)
    s = k.groupBy(F.col("true").alias("label")).agg(F.sum("n").alias("support"), of("correct"), of("neighbour"), of("other"))
    share = F.coalesce(F.col("neighbour") / F.nullif(F.col("neighbour") + F.col("other"), F.lit(0)), F.lit(0.0))
    chance = F.size(F.try_element_at(edges, F.col("label").cast("int"))) / F.lit(classes - 1)
    return s.withColumn("neighbour_share", share).withColumn("chance", chance).withColumn("lift", F.col("neighbour_share") / F.col("chance"))


def majority(df: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """(key, vote, n): the most frequent vote, the one seen first on a tie."""
    c = df.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    best = c.groupBy(key).agg(F.min_by(F.struct(vote, "n"), F.struct(-F.col("n"), "_o")).alias("b"))
    return best.select(key, f"b.{vote}", "b.n")


def best_per(df: DataFrame, group: str, score: str, order: str, columns: list[str]) -> DataFrame:
    """The row with the largest score of each group, the first by order on a tie; NULL and NaN scores lose."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    row = F.struct(*columns)
    return df.groupBy(group).agg(F.min_by(row, F.struct(s.isNull(), -s, order)).alias("r")).select(group, *[f"r.{c}" for c in columns if c != group])


def model_summary(df: DataFrame, model: str, dialect: Column, *scores: str) -> DataFrame:
    """(model, n, mean of each score, dialect_pct): per model the means of its scores, NULL and NaN left out, and the percentage
    of rows for which dialect holds."""
    mean = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in scores]
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("n"), *mean, (100 * F.count_if(dialect) / F.count(F.lit(1))).alias("dialect_pct"))
