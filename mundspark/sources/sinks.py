"""Writers for the tables, manifests and models that the pipelines leave behind."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """A table with header; NULL as a blank field, quotes doubled, spaces at the ends of texts kept. Arrays are joined by |."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_manifest(df: DataFrame, path: str) -> None:
    """Rows added to a manifest; each run adds files of its own, so runs do not race."""
    write_delimited(df, path, ",", "append")


def write_unquoted(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Lines without quotes; separators, line ends and backslashes inside values are escaped with a backslash."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit(sep), F.lit("\\" + sep)), F.lit("\n"), F.lit("\\\n"))
    df.select(F.concat_ws(sep, *[esc(c) for c in df.columns]).alias("value")).write.mode("overwrite").text(path)


def tee(df: DataFrame, outputs: dict[str, str | None]) -> None:
    """Several filtered copies of a table, computed once: path to condition, None for all rows."""
    from mundspark.runtime import staged

    once = staged(df, "tee")
    for path, condition in outputs.items():
        write_delimited(once if condition is None else once.where(condition), path)


def write_by_label(df: DataFrame, path: str, label: str, labels: list[int], sep: str = "\t") -> None:
    """A folder for each label, also for those without rows, in one pass over the table."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(label).csv(path, sep=sep, header=True)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in labels:
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{label}={x}"))


def write_summary(df: DataFrame, path: str) -> dict:
    """A one-row table as a JSON file on the driver; returns it."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    out = rows[0].asDict(recursive=True)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2, default=str)
    return out


def write_features(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Parquet files of at most so many rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def rewrite(spark: SparkSession, path: str, change, read=None) -> None:
    """A local table replaced by change(table): written beside it, then moved in its place, so a failure leaves the old."""
    old = (read or spark.read.parquet)(path)
    new = f"{path}.{uuid.uuid4().hex}"
    change(old).write.parquet(new)
    gone = f"{new}.old"
    os.rename(path, gone)
    os.rename(new, path)
    shutil.rmtree(gone)


def write_transcripts(segments: DataFrame, path: str, episode: str) -> None:
    """One JSON line for each episode with its segments in order of start and end; an episode is one value, as its readers
    need it."""
    s = F.struct("start", "end", "speaker", "text", "overlap_coverage")
    segments.groupBy(episode).agg(F.array_sort(F.collect_list(s)).alias("segments")).write.mode("overwrite").json(path)


def label_template(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows to be labelled by people: the columns and an empty label."""
    write_delimited(df.select(*columns, F.lit("").alias("label")), path, ",")


def save_bayes(model, path: str) -> None:
    """A NaiveBayes model as two parquet tables: its labels with their priors, and its terms."""
    model.terms.sparkSession.createDataFrame(list(zip(model.labels, model.priors)), f"label {model.kind}, prior double").coalesce(1).write.mode("overwrite").parquet(f"{path}/priors")
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")


def load_bayes(spark: SparkSession, path: str):
    from mundspark.operators.features import NaiveBayes

    classes = sorted(tuple(r) for r in spark.read.parquet(f"{path}/priors").select("label", "prior").collect())
    return NaiveBayes([c for c, _ in classes], [p for _, p in classes], spark.read.parquet(f"{path}/terms"))
