"""Probes and benchmarks: cross-validated classifiers on feature vectors, and models compared on the same records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.operators import errors, metrics
from mundspark.operators.rows import folds, sample_per_group
from mundspark.runtime import staged
from mundspark.sources.media import infer


def vectors(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(key, features, label) for Spark's classifiers; rows without a label or vector are left out."""
    d = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull())
    return d.select(F.col(key).alias("key"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))


def probe(df: DataFrame, vector: str, label: str, key: str, k: int = 5, seed: int = 13, make: Callable | None = None) -> DataFrame:
    """One row of scores (metrics.summary) of a classifier over k stratified folds, each row predicted by a model that has
    not seen it. make gives the classifier, logistic regression by default."""
    d = staged(folds(vectors(df, vector, label, key), "label", "key", k, seed), "folds")
    make = make or (lambda: LogisticRegression(maxIter=50, regParam=1e-3))
    parts = [make().fit(d.where(F.col("fold") != i)).transform(d.where(F.col("fold") == i)).select("label", "prediction") for i in range(k)]
    return metrics.summary(metrics.confusion(reduce(DataFrame.unionByName, parts), "label", "prediction"))


def perceptron(df: DataFrame, vector: str, label: str, key: str, width: int, classes: int, hidden: tuple[int, ...] = (64,), iterations: int = 60, seed: int = 42):
    """A fitted multilayer perceptron on vectors of a width, for labels 0 .. classes - 1."""
    return MultilayerPerceptronClassifier(layers=[width, *hidden, classes], maxIter=iterations, seed=seed).fit(vectors(df, vector, label, key))


def benchmark(records: DataFrame, models: dict[str, Callable], key: str, value: str, reference: str, label: str | None = None, per_label: int = 300, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(predictions, scores) of several models on one and the same sample of at most per_label records of each label.

    predictions: model, key, reference, prediction, reason, seconds; scores: model and, per label if given, pairs, wer and
    cer over the records that a model could do, and how many it could not. models: name to a function that loads one (see
    sources.media.infer)."""
    sample = staged(sample_per_group(records, label, key, per_label, seed) if label else records, "benchmark")
    out = None
    for name, load in models.items():
        got = infer(sample, key, value, load, sentinel=None).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got)
    cols = [key, F.col(reference).alias("reference"), *([F.col(label).alias("label")] if label else [])]
    p = staged(out.join(sample.select(*cols), key).withColumnRenamed("result", "prediction"), "predictions")
    groups = ["model", *(["label"] if label else [])]
    done = errors.corpus_rates(errors.error_rates(p.where("reason is null"), "reference", "prediction"), *groups)
    failed = p.groupBy(*groups).agg(F.count_if(F.col("reason").isNotNull()).alias("failed"))
    return p, failed.join(done, groups, "left")


def blocks(parts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """(key, features): vectors of several feature tables side by side, for keys that all have; parts: name to table and
    vector column. Tables are joined by key, not by row number."""
    out = None
    for name, (df, vector) in parts.items():
        d = df.select(F.col(key), F.transform(vector, lambda x: x.cast("double")).alias(name))
        out = d if out is None else out.join(d, key)
    joined: Column = F.concat(*[F.col(n) for n in parts])
    return out.select(key, joined.alias("features"))
