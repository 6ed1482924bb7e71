"""Distributions, coverage, balance and reconciliation reports. Each reads its table once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str], nulls: bool = True) -> DataFrame:
    """(column_name, value, n, pct) for each value of each column in one pass; pct is the share of the column's counted
    rows, in percent to one digit."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    n = df.select(pairs).select("p.*").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    if not nulls:
        n = n.where("value is not null")
    total = n.groupBy("column_name").agg(F.sum("n").alias("_of"))
    return n.join(total, "column_name").select("column_name", "value", "n", F.round(100 * F.col("n") / F.col("_of"), 1).alias("pct"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, blanks, nans) in one pass."""
    kinds = dict(df.dtypes)
    aggs = []
    for c in columns:
        blank = F.count_if(F.trim(F.col(c)) == "") if kinds[c] == "string" else F.lit(0).cast("long")
        nan = F.count_if(F.isnan(c)) if kinds[c] in ("double", "float") else (F.count_if(F.lower(F.trim(F.col(c))) == "nan") if kinds[c] == "string" else F.lit(0).cast("long"))
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"), blank.alias("blanks"), nan.alias("nans")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def nulls_per_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """(nulls, n): how many rows have so many NULLs."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return df.select(total.alias("nulls")).groupBy("nulls").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, grain: list[str], label: str, hours: Column, speaker: str, labels: dict[int, str], excluded: int) -> DataFrame:
    """For each grain and every label, also those without rows: clips, hours, speakers, and their shares of all and of
    all but the excluded label, in percent. Shares of nothing are 0."""
    have = df.where(F.col(label).isNotNull()).groupBy(*grain, label).agg(F.count(F.lit(1)).alias("clips"), F.sum(hours).alias("hours"), F.count_distinct(speaker).alias("speakers"))
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    every = F.array(*[F.lit(i) for i in labels])
    packed = have.groupBy(*grain).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("int"), F.struct("clips", "hours", "speakers")))).alias("m"))
    flat = packed.select(*grain, "m", F.explode(every).alias("label_id")).select(*grain, "label_id", F.try_element_at("m", F.col("label_id")).alias("v"), "m")
    total = lambda f, skip: F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] == skip, 0).otherwise(e["value"][f]))
    pct = lambda f, skip: F.when(F.col("label_id") == skip, 0.0).otherwise(F.coalesce(F.round(100 * F.col(f) / F.nullif(total(f, skip), F.lit(0)), 2), F.lit(0.0)))
    return flat.select(
        *grain, "label_id", F.try_element_at(names, F.col("label_id")).alias("label_name"), F.coalesce("v.clips", F.lit(0)).alias("clips"), F.coalesce("v.hours", F.lit(0.0)).alias("hours"), F.coalesce("v.speakers", F.lit(0)).alias("speakers"), "m",
    ).select(
        *grain, "label_id", "label_name", "clips", pct("clips", -1).alias("clips_pct_all"), pct("clips", excluded).alias("clips_pct_excl"), "hours", "speakers", pct("speakers", -1).alias("speakers_pct_all"), pct("speakers", excluded).alias("speakers_pct_excl"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, largest and smallest count, their ratio, severity (`severe` above 5, `moderate` above 2, else
    `balanced`)."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    r = n.agg(F.count(F.lit(1)).alias("classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    ratio = F.col("largest") / F.col("smallest")
    return r.withColumn("ratio", ratio).withColumn("severity", F.when(ratio > 5, "severe").when(ratio > 2, "moderate").otherwise("balanced"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequencies (at least 1e-6 of the rows), with mean 1 over the classes."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # over one row for each class
    w = n.withColumn("_w", 1 / F.greatest(F.col("n") / F.sum("n").over(every), F.lit(1e-6)))
    return w.select(label, "n", (F.col("_w") / F.avg("_w").over(every)).alias("weight"))


def split_summary(df: DataFrame, split: str, speaker: str, hours: Column) -> DataFrame:
    """Per split and in total (split `all`): rows, share, speakers, hours."""
    s = df.groupingSets([[F.col(split)], []], F.col(split)).agg(F.grouping(split).alias("_t"), F.count(F.lit(1)).alias("rows"), F.count_distinct(speaker).alias("speakers"), F.sum(hours).alias("hours"))
    of = F.max("rows").over(Window.partitionBy())  # over one row for each split; the total is the largest
    return s.select(F.when(F.col("_t") == 1, "all").otherwise(F.col(split)).alias(split), "rows", F.round(100 * F.col("rows") / of, 1).alias("pct"), "speakers", "hours")


def shared_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits, n): keys that occur in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count(F.lit(1)).alias("n")).where(F.size("splits") > 1)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once; NULL is a key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of only one of two tables, `only_a` or `only_b`; NULLs are no keys."""
    x, y = (t.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn(s, F.lit(True)) for t, s in ((a, "a"), (b, "b")))
    j = x.join(y, "key", "full_outer").where("a is null or b is null")
    return j.select(F.col("key").alias(key), F.when(F.col("b").isNull(), "only_a").otherwise("only_b").alias("side"))


def membership(base: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """base with a boolean in_<name> for each other table: whether it has the row's key."""
    for name, t in others.items():
        have = t.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn(f"_{name}", F.lit(True))
        base = base.join(have, F.col(key) == F.col("_k"), "left").withColumn(f"in_{name}", F.coalesce(f"_{name}", F.lit(False))).drop("_k", f"_{name}")
    return base


def line_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): the SHA-256 of all rows as tab-joined lines in sorted order, each with a line end; NULL is the empty
    text. The digest is one sequential sum by its definition: rows are sorted on the executors and pass through the driver
    one partition at a time, so it suits data sets of evaluation size; see fingerprint for a table of any size."""
    import hashlib

    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    digest, n = hashlib.sha256(), 0
    for r in df.select(line.alias("l")).orderBy("l").toLocalIterator():
        digest.update(r[0].encode() + b"\n")
        n += 1
    return df.sparkSession.createDataFrame([(n, digest.hexdigest())], "rows long, digest string")


def reconcile(source: DataFrame, merged: DataFrame, key: str, group: str) -> DataFrame:
    """(group, source, kept, dropped): different keys of source per group, those that merged has too, and the rest. A key in
    several groups counts in each; NULL keys are left out, a NULL group is a group."""
    have = merged.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_in", F.lit(True))
    s = source.select(group, F.col(key).alias("_k")).where("_k is not null").distinct().join(have, "_k", "left")
    return s.groupBy(group).agg(F.count(F.lit(1)).alias("source"), F.count("_in").alias("kept"), F.count_if(F.col("_in").isNull()).alias("dropped"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): an order-free fingerprint. The SHA-256 of each row's tab-joined columns is cut to four 60-bit
    numbers whose sums, modulo 2^60, are hashed; partial sums travel, not rows."""
    line = F.sha2(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    parts = [F.conv(F.substr(line, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"p{i}") for i in range(4)])
    mod = [(F.col(f"p{i}") % F.lit(1 << 60)).cast("long").cast("string") for i in range(4)]
    return sums.select("rows", F.sha2(F.concat_ws("|", *mod), 256).alias("digest"))
