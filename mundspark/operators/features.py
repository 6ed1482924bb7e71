"""Text features and classifiers: n-grams, TF-IDF, multinomial naive Bayes, two-stage labels.

A document-term table is either long, (doc, term, tf), or has one row for each document with an array of its terms. In the
latter n-grams are counted within the row, by 64-bit codes, so that nothing is shuffled but what is summed up by term.
Nothing is densified: vocabularies and models are tables that are joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.operators import linear
from mundspark.runtime import staged

#: Smoothing of naive Bayes, sizes of n-grams, least document frequency.
ALPHA, SIZES, MIN_DF = 0.1, (2, 3, 4), 2


def tokens(text: Column, lower: bool = True, drop: tuple[str, ...] = ()) -> Column:
    """Tokens of a text between spaces, in lower case unless told otherwise; NULL gives none."""
    t = F.lower(F.coalesce(text, F.lit(""))) if lower else F.coalesce(text, F.lit(""))
    return F.filter(F.split(t, " "), lambda x: ~x.isin("", *drop))


def ngrams(array: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """All n-grams of an array of tokens, joined by spaces; an array column."""
    each = [f"case when size({array}) >= {n} then transform(sequence(1, size({array}) - {n} + 1), i -> array_join(slice({array}, i, {n}), ' ')) else cast(array() as array<string>) end" for n in sizes]
    return F.expr(f"concat({', '.join(each)})")


def term_counts(df: DataFrame, doc: str, text: Column, sizes: tuple[int, ...] = SIZES, lower: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, tf): how often each n-gram occurs in each document. A document's terms are counted before any
    shuffle, as far as its rows go."""
    d = df.select(F.col(doc).alias("doc"), tokens(text, lower, drop).alias("_t"))
    return d.select("doc", F.explode(ngrams("_t", sizes)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_arrays(df: DataFrame, doc: str, text: Column, keep: tuple[str, ...] = (), sizes: tuple[int, ...] = SIZES, lower: bool = True, drop: tuple[str, ...] = ()) -> DataFrame:
    """(doc, keep..., terms): one row for each row of df, whose doc is unique; terms is an array of (term, tf), term being
    the 64-bit code of an n-gram."""
    h = F.transform(tokens(text, lower, drop), lambda x: F.xxhash64(x))
    d = df.select(F.col(doc).alias("doc"), *keep, h.alias("_h"))
    each = [f"case when size(_h) >= {n} then transform(sequence(0, size(_h) - {n}), i -> xxhash64({', '.join(f'_h[i + {k}]' for k in range(n))})) else cast(array() as array<bigint>) end" for n in sizes]
    d = d.select("doc", *keep, F.sort_array(F.expr(f"concat({', '.join(each)})")).alias("_g"))
    begins = "case when size(_g) = 0 then cast(array() as array<int>) else filter(sequence(0, size(_g) - 1), i -> i = 0 or _g[i] <> get(_g, i - 1)) end"
    d = d.select("doc", *keep, "_g", F.expr(begins).alias("_b"))
    return d.select("doc", *keep, F.expr("transform(_b, (i, k) -> struct(_g[i] as term, cast(coalesce(get(_b, k + 1), size(_g)) - i as bigint) as tf))").alias("terms"))


def in_rows(arrays: DataFrame, *keep: str) -> DataFrame:
    """(keep..., term, tf) of term_arrays."""
    return arrays.select(*keep, F.inline("terms"))


def vocabulary(counts: DataFrame, min_df: int = MIN_DF, max_df: float = 1.0, docs: int | None = None) -> DataFrame:
    """(term, df, cf) of the terms in at least min_df documents and at most a share max_df of them."""
    v = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    return v if max_df >= 1.0 or docs is None else v.where(F.col("df") <= max_df * docs)


def tfidf(counts: DataFrame, vocab: DataFrame, docs: int) -> DataFrame:
    """(doc, terms): an array of (term, weight) for each document with known terms. Sublinear term frequency 1 + ln tf,
    smooth idf ln((1 + n) / (1 + df)) + 1, rows of unit length."""
    w = counts.join(vocab.select("term", "df"), "term")
    w = w.select("doc", "term", ((1 + F.log("tf")) * (F.log(F.lit(1.0 + docs) / (1 + F.col("df"))) + 1)).alias("_w"))
    g = w.groupBy("doc").agg(F.collect_list(F.struct("term", "_w")).alias("_t"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return g.select("doc", F.transform("_t", lambda x: F.struct(x["term"].alias("term"), (x["_w"] / F.col("_norm")).alias("weight"))).alias("terms"))


def class_counts(rows: DataFrame, labels: list) -> DataFrame:
    """(term, n, d) from (label, term, tf): arrays of a term's occurrences and documents in each of the labels. One row a
    term, summed before the shuffle."""
    n = [F.sum(F.when(F.col("label") == x, F.col("tf")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(labels)]
    d = [F.count_if(F.col("label") == x).alias(f"d{i}") for i, x in enumerate(labels)]
    pick = lambda k: F.array(*[f"{k}{i}" for i in range(len(labels))]).cast("array<bigint>").alias(k)
    return rows.groupBy("term").agg(*n, *d).select("term", pick("n"), pick("d"))


class NaiveBayes:
    """Multinomial naive Bayes: labels in ascending order, their log priors, and a table (term, ll) with the array of a
    vocabulary term's log-likelihoods."""

    def __init__(self, labels: list, priors: list[float], terms: DataFrame):
        self.labels, self.priors, self.terms = labels, priors, terms

    @property
    def kind(self) -> str:
        """The type of its labels."""
        return "string" if any(isinstance(x, str) for x in self.labels) else "int"

    @staticmethod
    def of(counts: DataFrame, docs: dict, classes: dict, min_df: int = MIN_DF, alpha: float = ALPHA) -> NaiveBayes:
        """From class_counts, staged, of the labels of docs, in ascending order, and their numbers of documents. classes gives
        the labels of each class; documents of no class take no part. The prior is a class's share of the documents,
        unsmoothed."""
        at = {x: i for i, x in enumerate(docs)}
        names = sorted(c for c in classes if sum(docs.get(x, 0) for x in classes[c]))
        total = lambda col, labels: sum((F.col(col)[at[x]] for x in labels if x in at), F.lit(0))
        df = total("d", [x for c in names for x in classes[c]])
        v = counts.where(df >= min_df).select("term", *[total("n", classes[c]).alias(f"c{i}") for i, c in enumerate(names)])
        sums = v.agg(F.count(F.lit(1)).alias("size"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(names))]).first()
        ll = [F.log((F.col(f"c{i}") + alpha) / F.lit(sums[f"c{i}"] + alpha * sums["size"])) for i in range(len(names))]
        members = [sum(docs.get(x, 0) for x in classes[c]) for c in names]
        terms = v.select("term", (F.array(*ll) if ll else F.array()).cast("array<double>").alias("ll"))
        return NaiveBayes(names, [math.log(n / sum(members)) for n in members], staged(terms, "likelihoods"))

    @staticmethod
    def fit(rows: DataFrame, labels: DataFrame, min_df: int = MIN_DF, alpha: float = ALPHA) -> NaiveBayes:
        """From (doc, term, tf) and (doc, label)."""
        known = labels.where("label is not null")
        docs = label_counts(known)
        return NaiveBayes.of(staged(class_counts(rows.join(known, "doc"), list(docs)), "class-counts"), docs, {x: [x] for x in docs}, min_df, alpha)

    def probabilities(self, rows: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc, label, p) for every class; see scores."""
        return probabilities(scores([self], rows, docs), 0, self.labels)

    def predict(self, rows: DataFrame, docs: DataFrame) -> DataFrame:
        """(doc, label, confidence): the best class of each document, the lower label on a tie, and its probability."""
        s = scores([self], rows, docs).withColumn("_m", F.array_max("s0"))
        total = F.aggregate("s0", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_m")))
        label = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.array_position("s0", F.col("_m")).cast("int"))
        return s.select("doc", label.alias("label"), (1 / total).alias("confidence"))


def label_counts(labels: DataFrame) -> dict:
    """Documents of each label (one row a label), in ascending order."""
    return {r.label: r.n for r in sorted(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.label)}


def scores(models: list[NaiveBayes], rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, s0, s1, ...) for every document of docs: the array of log-joint scores by each model. Terms outside a
    vocabulary are passed over, a document without any has its prior. All models' likelihoods meet a document's terms in
    one join, and are summed within a document before they are shuffled."""
    terms = None
    for k, m in enumerate(models):
        t = m.terms.select("term", F.col("ll").alias(f"l{k}"))
        terms = t if terms is None else terms.join(t, "term", "full")
    if len(models) > 1:
        terms = staged(terms, "likelihoods")
    sums = [F.sum(F.col("tf") * F.col(f"l{k}")[i]).alias(f"s{k}_{i}") for k, m in enumerate(models) for i in range(len(m.labels))]
    g = rows.join(terms, "term").groupBy("doc").agg(*sums)
    each = [F.array(*[F.lit(p) + F.coalesce(f"s{k}_{i}", F.lit(0.0)) for i, p in enumerate(m.priors)]).alias(f"s{k}") for k, m in enumerate(models)]
    return docs.select("doc").join(g, "doc", "left").select("doc", *each)


def probabilities(s: DataFrame, k: int, labels: list) -> DataFrame:
    """(doc, label, p) of the k-th model from scores."""
    e = s.select("doc", F.transform(f"s{k}", lambda x: F.exp(x - F.array_max(f"s{k}"))).alias("_e"))
    e = e.withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return e.select("doc", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), (F.col("_e")[i] / F.col("_t")).alias("p")) for i, x in enumerate(labels)])))


def mean_probabilities(p: DataFrame, doc_group: DataFrame) -> DataFrame:
    """(group, label, p, docs): mean probability of each class over a group's documents."""
    return p.join(doc_group, "doc").groupBy("group", "label").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("docs"))


def probability_summary(p: DataFrame, doc_group: DataFrame, label: int = 1) -> DataFrame:
    """(group, docs, mean, median, most): a class's probabilities over a group's documents."""
    one = p.where(F.col("label") == label).join(doc_group, "doc")
    return one.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.avg("p").alias("mean"), F.median("p").alias("median"), F.max("p").alias("most"))


def two_stage(groups: DataFrame, binary: DataFrame, fine: DataFrame, german: int = 7) -> DataFrame:
    """(group, is_german, prob_german, label_id, confidence) of every group: German if its mean probability of class 1 is
    at least that of class 0 is not, i.e. if class 1 wins; else the class with the largest mean probability of the second
    stage. A group without documents is German with probability 1. Ties, to twelve digits, go to the lower class."""
    b = binary.groupBy("group").agg(F.max(F.when(F.col("label") == 1, F.col("p"))).alias("pg"))
    f = fine.groupBy("group").agg(F.min_by(F.struct("label", "p"), F.struct(-F.round("p", 12), "label")).alias("f"))
    j = groups.select("group").distinct().join(b, "group", "left").join(f, "group", "left")
    pg = F.coalesce("pg", F.lit(1.0))
    is_german = pg > 0.5
    return j.select("group", is_german.cast("int").alias("is_german"), pg.alias("prob_german"), F.when(is_german, german).otherwise(F.col("f.label")).alias("label_id"), F.when(is_german, pg).otherwise(F.col("f.p")).alias("confidence"))


def linear_model(rows: DataFrame, counts: dict, features: int = 1 << 18, reg: float = 1e-4, iterations: int = 50) -> linear.LinearModel:
    """A multinomial logistic regression on hashed_rows, staged, with class weights balanced by counts, the documents of
    each label (see label_counts)."""
    return linear.fit(rows, counts, features, reg, iterations)


def hashed_rows(counts: DataFrame, vocab: DataFrame, docs: int, labels: DataFrame, features: int = 1 << 18) -> DataFrame:
    """The TF-IDF rows (see tfidf) of hashed terms, colliding terms summed, packed into blobs of numbers. labels has (doc,
    label, held); rows to fit and rows held back are in different blobs, by held. Only slots and counts are shuffled."""
    slot = F.pmod(F.xxhash64("term"), F.lit(features)).cast("int")
    w = counts.join(vocab.select("term", "df"), "term").select("doc", F.struct(slot.alias("slot"), F.col("tf").cast("int").alias("tf"), F.col("df").cast("int").alias("df")).alias("t"))
    return linear.pack(w.groupBy("doc").agg(F.collect_list("t").alias("terms")).join(labels, "doc"), docs, features)


def per_dimension(df: DataFrame, vector: str) -> DataFrame:
    """(dim, n, mean, std): population statistics of each place of an array column."""
    e = df.select(F.posexplode(vector).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    return e.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def pooled(vector: Column) -> Column:
    """A struct of mean, population deviation and mean magnitude of an array of numbers; NULLs for an empty one."""
    n = F.nullif(F.size(vector), F.lit(0))
    total = lambda f: F.aggregate(vector, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    mean = total(lambda x: x) / n
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(total(lambda x: x * x) / n - mean * mean, F.lit(0.0))).alias("std"), (total(lambda x: F.abs(x)) / n).alias("magnitude"))


def frames(vector: Column, size: int, hop: int, coverage: float = 0.8) -> Column:
    """Windows of an array, `hop` apart, padded with zeros at its end; a last window is kept if at least the share
    coverage of it is filled, and the first always."""
    n = F.size(vector)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(hop)), lambda i: (i == 0) | (n - i >= coverage * size))
    zero = F.lit(0.0)
    return F.transform(starts, lambda i: F.concat(F.transform(F.slice(vector, i + 1, F.lit(size)), lambda x: x.cast("double")), F.array_repeat(zero, F.greatest(F.lit(size) - F.greatest(n - i, F.lit(0)), F.lit(0)).cast("int"))))


def fixed_length(vector: Column, size: int) -> Column:
    """An array cut or padded with zeros to a fixed length."""
    return F.concat(F.transform(F.slice(vector, 1, size), lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(vector), F.lit(0)).cast("int")))
