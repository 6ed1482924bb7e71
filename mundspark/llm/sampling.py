"""Problem 5: samples that match target proportions per category.

The records are counted in cells (category by every other margin). For each target set the cell counts are raked by
iterative proportional fitting to the wanted sizes of the categories and to the population's shares of the other
margins, with no cell above its count. A record's chance is its cell's raked share; records are ordered within their
category by weighted exponential keys, -ln(1 - u) / weight, u being a hash of the record's key, and the first n are
drawn, n being the wanted size bounded by what there is. Categories that are then below their minimum are repaired: they
are drawn on in the same order. The report tells what the drawn rows lack. The cells are the only thing gathered; in a
margin all values but the MARGIN most frequent count as one, which bounds them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.functions.regions import region_label
from mundspark.operators.prefix import first_n, uniform
from mundspark.runtime import staged


def category(label: str = "label_id", region: str = "dialect_region") -> Column:
    """label_id or, where that is NULL, the label of the region named in dialect_region; NULL without either."""
    return F.coalesce(F.col(label).cast("int"), region_label(F.col(region)))


#: Least share of its count that a raked cell keeps.
LEAST = 1e-12
#: Values of a margin that are raked each on its own.
MARGIN = 64
#: What stands for the other values of a margin.
OTHER = "\u0001"


def frequent(cells: DataFrame, margin: str, size: str) -> list[str]:
    """The MARGIN values of a margin with the largest sums of size, ties by value."""
    n = cells.groupBy(margin).agg(F.sum(size).alias("_n")).orderBy(F.desc("_n"), margin).limit(MARGIN)
    return [r[0] for r in n.collect()]


def folded(margin: str, values: list[str]) -> Column:
    """A margin with OTHER for all but some values."""
    return F.when(F.col(margin).isin(values), F.col(margin)).otherwise(OTHER).alias(margin)


def weighted_order(u: Column, weight: Column) -> Column:
    """The weighted exponential key -ln(1 - u) / weight, mapped to [0, 1) in the same order. It is the key's logarithm that
    is mapped, so keys of very small weights stay apart too."""
    key = -F.log1p(-F.greatest(u, F.lit(2.0**-54))) / weight
    return F.least(F.greatest((F.log(key) + 40) / 80, F.lit(0.0)), F.lit(1 - 1e-12))


def rake(counts: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Cell sizes in [0, counts] whose sums over the groups of each margin come as near to the targets as they can.
    members: for each margin the group of each cell; targets: for each margin the wanted sum of each group. The first
    margin is fitted last in every round and once more at the end until it holds, as far as the counts go. A cell with
    a count is 0 only if its group of the first margin wants nothing: what is 0 could not grow again."""
    least = counts * LEAST * (targets[0] > 0)[members[0]]
    x = np.maximum(counts.astype(float) * min(1.0, targets[0].sum() / max(counts.sum(), 1)), least)

    def fitted(x: np.ndarray, group: np.ndarray, wanted: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):  # cells that hit their count pass what they lack to the others of their group
            at = np.bincount(group, x, len(wanted))
            free = np.bincount(group, np.where(x < counts, x, 0), len(wanted))
            # too large a sum shrinks with all its cells, too small a one grows by those below their count
            factor = np.where(wanted < at, wanted / np.maximum(at, 1e-300), np.where(free > 0, 1 + (wanted - at) / np.where(free > 0, free, 1), 1.0))
            new = np.minimum(np.maximum(np.where((wanted < at)[group] | (x < counts), x * factor[group], x), least), counts)
            moved = np.abs(new - x).max(initial=0)
            x = new
            if moved < tolerance:
                break
        return x

    for _ in range(rounds):
        before = x
        for group, wanted in list(zip(members, targets))[::-1]:
            x = fitted(x, group, wanted, 20)
        if np.abs(x - before).max(initial=0) < tolerance * max(1, counts.max(initial=0)):
            break
    return fitted(x, members[0], targets[0], len(counts) + 2)  # a step fills a cell at least, or reaches the sum


class Sampler:
    """Samples of df for every target set. df needs `key` (unique) and the columns of `category` and of the margins;
    targets: target_set, sample_share, label_id, target_share, min_rows. NULL margins are a value like any other."""

    def __init__(self, df: DataFrame, targets: DataFrame, key: str, category: Column, margins: list[str], seed: int = 11):
        self.key, self.seed, self.margins = key, seed, margins
        cols = [F.coalesce(F.lower(F.trim(F.col(m))), F.lit("")).alias(f"_m{i}") for i, m in enumerate(margins)]
        self.names = [f"_m{i}" for i in range(len(margins))]
        self.rows = df.select(F.col(key).alias("key"), category.alias("label_id"), *cols).where("label_id is not null")
        cells = staged(self.rows.groupBy("label_id", *self.names).agg(F.count(F.lit(1)).alias("n")), "cells")
        fold = [folded(m, frequent(cells, m, "n")) for m in self.names]
        self.rows = self.rows.select("key", "label_id", *fold)
        self.cells = staged(cells.select("label_id", *fold, "n").groupBy("label_id", *self.names).agg(F.sum("n").alias("n")), "cells")
        everything = self.cells.agg(F.sum("n")).first()[0] or 0
        have = self.cells.groupBy("label_id").agg(F.sum("n").alias("available"))
        q = targets.join(have, "label_id", "left").withColumn("all", F.lit(everything))
        wanted = F.col("target_share") * F.col("sample_share") * F.col("all")
        q = q.select("target_set", "label_id", "target_share", "min_rows", (F.col("sample_share") * F.col("all")).alias("size"), wanted.alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"))
        n = F.least(F.round("wanted"), F.col("available")).cast("long")
        least = F.least(F.greatest(F.round("wanted"), F.coalesce("min_rows", F.lit(0))), F.col("available")).cast("long")
        self.quotas = staged(q.withColumn("n", n).withColumn("least", least), "quotas")

    def weights(self) -> DataFrame:
        """(target_set, label_id, margins, count, expected): raked size of every cell."""
        margins, names = self.margins, self.names
        population = self.cells

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            counts = pdf["n"].to_numpy(float)
            members, targets = [], []
            group, values = pd.factorize(pdf["label_id"])
            members.append(group)
            targets.append(pdf.groupby("label_id", sort=False)["quota"].first().reindex(values).to_numpy(float))
            for i in range(len(margins)):
                group, values = pd.factorize(pdf[f"_m{i}"])
                members.append(group)
                share = pdf.groupby(f"_m{i}", sort=False)[f"_p{i}"].first().reindex(values).to_numpy(float)
                targets.append(share / max(share.sum(), 1e-300) * targets[0].sum())
            return pdf[["target_set", "label_id", *names, "n"]].assign(expected=rake(counts, members, targets))

        c = population
        for i, m in enumerate(names):
            c = c.join(population.groupBy(m).agg(F.sum("n").alias(f"_p{i}")), m)
        c = c.join(self.quotas.select("target_set", "label_id", F.col("least").alias("quota")), "label_id")
        schema = "target_set string, label_id int, " + "".join(f"{m} string, " for m in names) + "n long, expected double"
        return c.groupBy("target_set").applyInPandas(fit, schema)

    def draw(self) -> DataFrame:
        """(target_set, key, label_id, weight): the samples. weight is the number of records of its cell that a drawn
        record stands for."""
        w = staged(self.weights(), "weights")
        mean = w.groupBy("target_set", "label_id").agg((F.sum("expected") / F.sum("n")).alias("mean"))
        # every cell of a category that wants rows expects some, see rake
        w = w.join(mean, ["target_set", "label_id"]).where("expected > 0").select("target_set", "label_id", *self.names, (F.col("expected") / F.col("n")).alias("chance"), (F.col("expected") / F.col("n") / F.col("mean")).alias("ratio"))
        r = self.rows.join(staged(w, "chances"), ["label_id", *self.names])  # as many rows as cells: broadcast while small
        u = uniform("target_set", "key", seed=self.seed)
        r = r.withColumn("order", weighted_order(u, F.col("ratio")))
        groups = ["target_set", "label_id"]
        lacking = self.quotas.where("least > n")
        whole = first_n(r.join(lacking.select(*groups), groups, "left_anti"), groups, "order", "key", self.quotas.where("n > 0"), "n")
        # a repaired category is drawn on: what it has already comes first in the same order
        picked = whole.unionByName(first_n(r.join(lacking.select(*groups), groups, "left_semi"), groups, "order", "key", lacking, "least")) if not lacking.isEmpty() else whole
        return picked.select("target_set", F.col("key").alias(self.key), "label_id", (1 / F.col("chance")).alias("weight"))

    def report(self) -> DataFrame:
        """Per target set and category: wanted and drawn rows, the share reached, whether the category falls short of
        its share (it is drawn whole and that is not enough) or its minimum."""
        drawn = self.draw().groupBy("target_set", "label_id").agg(F.count(F.lit(1)).alias("drawn"))
        j = self.quotas.join(drawn, ["target_set", "label_id"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        return j.select(
            "target_set", "label_id", "target_share", "min_rows", "wanted", "available", "drawn",
            F.when(F.col("size") > 0, F.col("drawn") / F.col("size")).alias("share"),
            (F.greatest(F.col("wanted"), F.coalesce("min_rows", F.lit(0))) - F.col("drawn")).alias("gap"),
            ((F.col("drawn") == F.col("available")) & (F.col("drawn") < F.col("wanted"))).alias("short"),
            (F.col("drawn") < F.coalesce("min_rows", F.lit(0))).alias("below_minimum"),
        )
