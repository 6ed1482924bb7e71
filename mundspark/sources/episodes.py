"""Episodes, metric files and trainer logs, in the JSON and CSV that pipelines leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENTS = "array<struct<start: double, end: double, speaker: string, text: string, overlap_coverage: double>>"


def _name(depth: int = 1):
    return F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -depth), r"\.[^.]*$", "")


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(episode, start, end, speaker, text, overlap_coverage) of every transcript below root: `*.json` with a list
    segments, `*.csv` with the columns. The episode is the file's name; a missing overlap_coverage is 0."""
    opts = {"recursiveFileLookup": "true"}
    j = spark.read.options(**opts, pathGlobFilter="*.json", multiLine=True).schema(f"segments {_SEGMENTS}").json(root)
    j = j.select(_name().alias("episode"), F.inline("segments"))
    c = spark.read.options(**opts, pathGlobFilter="*.csv", header=True, quote='"', escape='"').csv(root)
    cols = [F.col(x).try_cast(t).alias(x) if x in c.columns else F.lit(None).cast(t).alias(x) for x, t in (("start", "double"), ("end", "double"), ("speaker", "string"), ("text", "string"), ("overlap_coverage", "double"))]
    both = j.unionByName(c.select(_name().alias("episode"), *cols))
    return both.withColumn("overlap_coverage", F.coalesce("overlap_coverage", F.lit(0.0)))


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(run, accuracy, macro_f1, confusion) of the metric files below root; the run is the folder. Accuracy comes as acc or
    accuracy, the matrix as cm or confusion_matrix."""
    m = "array<array<bigint>>"
    d = spark.read.options(recursiveFileLookup="true", pathGlobFilter="*.json", multiLine=True).schema(f"acc double, accuracy double, macro_f1 double, cm {m}, confusion_matrix {m}").json(root)
    d = d.select(_name(2).alias("run"), F.coalesce("acc", "accuracy").alias("accuracy"), "macro_f1", F.coalesce("cm", "confusion_matrix").alias("confusion"))
    return d.where("accuracy is not null or macro_f1 is not null or confusion is not null")


def confusion_cells(metrics: DataFrame) -> DataFrame:
    """(run, true, pred, n) from the matrices of read_metrics."""
    r = metrics.select("run", F.posexplode("confusion").alias("true", "row"))
    return r.select("run", "true", F.posexplode("row").alias("pred", "n"))


def accuracy_mismatch(metrics: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(run, accuracy, from_matrix) where the two differ by more than the tolerance."""
    c = confusion_cells(metrics).groupBy("run").agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("from_matrix"))
    return metrics.join(c, "run").where(F.abs(F.col("accuracy") - F.col("from_matrix")) > tolerance).select("run", "accuracy", "from_matrix")


def read_trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, epoch, loss, learning_rate, grad_norm) of trainer states; entries without a loss are left out."""
    entry = "array<struct<step: bigint, epoch: double, loss: double, learning_rate: double, grad_norm: double>>"
    d = spark.read.options(multiLine=True, recursiveFileLookup="true", pathGlobFilter="*.json").schema(f"log_history {entry}").json(path)
    return d.select(_name(2).alias("run"), F.inline("log_history")).where("loss is not null")


def processed(spark: SparkSession, manifests: str) -> DataFrame:
    """(podcast, episode) that the manifests list as done."""
    return spark.read.options(header=True, recursiveFileLookup="true", pathGlobFilter="*.csv").csv(manifests).select("podcast", "episode").distinct()


def training_size(samples: int, batch: int, accumulate: int, devices: int, epochs: int, steps: int | None = None) -> dict[str, int]:
    """Steps of an epoch, steps of all, samples seen by a number of steps."""
    effective = batch * accumulate * devices
    per = -(-samples // effective)
    total = per * epochs
    return {"effective_batch": effective, "steps_per_epoch": per, "steps": total, "samples_seen": (total if steps is None else steps) * effective}
