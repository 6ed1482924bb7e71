"""Problem 9: mixes of documents in which every source reaches its share of the tokens.

Token counts are gathered in cells of source, language and topic. For each mix the cells are raked (sampling.rake) to
the wanted tokens of the sources and to the languages' and topics' shares of the tokens of those sources, no cell above
max_repeat times its tokens. A cell's rate, raked tokens by its own, is the number of copies each of its documents
should have: the whole part is given to all of them, the rest to documents in the order of weighted exponential keys
until the source's tokens are reached, and if these do not suffice to any document below max_repeat. Only cells of listed
sources are gathered, one row for each combination; in languages and topics, all values but the most frequent count as one
(sampling.MARGIN), which bounds them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.llm.languages import language_of_label
from mundspark.llm.sampling import folded, frequent, rake, weighted_order
from mundspark.llm.tokenize import VOCABULARY, token_ids
from mundspark.operators.prefix import running_before, uniform
from mundspark.runtime import staged


class Mixer:
    """Mixes of docs (key, text, source, language, topic) for targets (mix_name, size_share, source, weight,
    max_repeat). NULL and empty texts have no tokens and are never used; NULL sources cannot be listed; a source listed
    twice in a mix is taken once for each row's weight together, with the larger max_repeat. NULL languages and topics
    are values like others."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, language: Column, topic: Column, vocabulary: str = VOCABULARY, seed: int = 13):
        self.key, self.seed = key, seed
        cols = {"source": F.col(source), "lang": F.coalesce(language, F.lit("")), "topic": F.coalesce(topic, F.lit(""))}
        self.docs = staged(token_ids(docs.withColumn("_doc", F.col(key)), "_doc", F.col(text), vocabulary, counts=True, keep=cols).withColumnRenamed("_doc", "key"), "doc-tokens")
        cells = staged(self.docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs")), "mix-cells")
        fold = [folded(m, frequent(cells, m, "tokens")) for m in ("lang", "topic")]
        self.docs = self.docs.select("key", "n_tokens", "source", *fold)
        self.cells = staged(cells.select("source", *fold, "tokens", "docs").groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")), "mix-cells")
        everything = self.cells.agg(F.sum("tokens")).first()[0] or 0
        have = self.cells.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
        t = targets.groupBy("mix_name", "source").agg(F.max("size_share").alias("size_share"), F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"))
        wanted = F.col("weight") * F.col("size_share") * F.lit(everything)
        t = t.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("wanted", wanted)
        reachable = F.col("max_repeat") * F.col("tokens")
        self.targets = staged(t.withColumn("reachable", reachable).withColumn("size", F.col("size_share") * F.lit(everything)).withColumn("aim", F.least("wanted", "reachable")), "mix-targets")

    def rates(self) -> DataFrame:
        """(mix_name, source, lang, topic, rate): copies that each document of a cell should have."""

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            caps = (pdf["tokens"] * pdf["max_repeat"]).to_numpy(float)
            members, wanted = [], []
            group, values = pd.factorize(pdf["source"])
            members.append(group)
            wanted.append(pdf.groupby("source", sort=False)["aim"].first().reindex(values).to_numpy(float))
            for c in ("lang", "topic"):
                group, values = pd.factorize(pdf[c])
                at = np.bincount(group, pdf["tokens"].to_numpy(float), len(values))
                members.append(group)
                wanted.append(at / max(at.sum(), 1e-300) * wanted[0].sum())
            rate = rake(caps, members, wanted) / np.maximum(pdf["tokens"].to_numpy(float), 1e-300)
            return pdf[["mix_name", "source", "lang", "topic"]].assign(rate=np.where(pdf["tokens"] > 0, rate, 0.0))

        c = self.cells.where("tokens > 0").join(self.targets.select("mix_name", "source", "max_repeat", "aim"), "source")
        return c.select("mix_name", "source", "lang", "topic", "tokens", "max_repeat", "aim").groupBy("mix_name").applyInPandas(fit, "mix_name string, source string, lang string, topic string, rate double")

    def copies(self) -> DataFrame:
        """(mix_name, source, key, n_tokens, copies): how often each document of a mix is used."""
        return self._drawn().drop("max_repeat")

    def _drawn(self) -> DataFrame:
        rates = staged(self.rates(), "mix-rates").join(self.targets.select("mix_name", "source", "max_repeat", "aim"), ["mix_name", "source"])
        d = self.docs.where("n_tokens > 0").join(staged(rates, "mix-plan"), ["source", "lang", "topic"])  # as many rows as cells: broadcast while small
        whole = F.least(F.floor(F.col("rate") + 1e-9), F.col("max_repeat")).cast("int")
        d = d.withColumn("whole", whole).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
        given = d.groupBy("mix_name", "source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("given"), F.max("part").alias("most"))
        d = d.join(staged(given, "mix-given"), ["mix_name", "source"])  # one row for each target: broadcast while small
        more = d.where((F.col("given") < F.col("aim")) & (F.col("whole") < F.col("max_repeat")))
        u = uniform("mix_name", "key", seed=self.seed)
        keyed = weighted_order(u, F.col("part") / F.col("most"))
        order = F.when(F.col("part") > 1e-9, keyed / 2).otherwise((1 + u) / 2)  # cells with no part of a copy left come last
        more = more.select("mix_name", "source", "key", "n_tokens", order.alias("order"), (F.col("aim") - F.col("given")).alias("left"))
        more = running_before(more, ["mix_name", "source"], "order", "key", "n_tokens", "before").where("before + n_tokens / 2 <= left")
        extra = more.select("mix_name", "key", F.lit(1).alias("extra"))
        j = d.join(extra, ["mix_name", "key"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
        return j.where("copies > 0").select("mix_name", "source", F.col("key").alias(self.key), "n_tokens", "copies", "max_repeat")

    def report(self) -> DataFrame:
        """Per mix and source: wanted, reachable and actual tokens, documents, wanted and actual share of the mix, and
        whether the source cannot reach its weight: every document of it is drawn max_repeat times, and still its tokens
        are fewer than wanted."""
        used = self._drawn().groupBy("mix_name", "source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("actual"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"), F.count_if(F.col("copies") == F.col("max_repeat")).alias("full")
        )
        j = self.targets.join(used, ["mix_name", "source"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
        return j.select(
            "mix_name", "source", "weight", "max_repeat", "wanted", "reachable", "actual", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.when(F.col("size") > 0, F.col("actual") / F.col("size")).alias("share"), ((F.col("actual") < F.col("wanted")) & (F.coalesce("full", F.lit(0)) == F.col("docs"))).alias("short"),
        )


def mixer(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> Mixer:
    """A Mixer over the documents table: delivered language in any spelling, doc_type as topic."""
    return Mixer(docs, targets, "doc_id", "text", "source", language_of_label(F.col("lang")), F.col("doc_type"), vocabulary)
