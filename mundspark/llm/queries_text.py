"""Queries of problems 1 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.llm.overlap import cross_split_pairs, span_coverage
from mundspark.llm.tokenize import token_ids
from mundspark.runtime import table


def _splits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cols = ["utt_id", "sentence", "client_id", "audio_path", "dataset"]
    valid, test = (table(spark, sf, f"merged_{x}").select(*cols, F.lit(x).alias("split")) for x in ("valid", "test"))
    return table(spark, sf, "merged_train").select(*cols), valid.unionByName(test)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a training and an evaluation record of the same recording, smaller id first."""
    train, ev = _splits(spark, sf)
    p = cross_split_pairs(train, ev)
    return p.select(F.least("train_id", "eval_id").alias("utt_id_a"), F.greatest("train_id", "eval_id").alias("utt_id_b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation split and dataset: records, those that training holds too, and pairs."""
    train, ev = _splits(spark, sf)
    hits = cross_split_pairs(train, ev).groupBy(F.col("eval_id").alias("utt_id")).agg(F.count(F.lit(1)).alias("n"))
    return ev.join(hits, "utt_id", "left").groupBy("split", "dataset").agg(
        F.count(F.lit(1)).alias("records"), F.count("n").alias("leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")
    )


def p1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each evaluation record that lie in spans of five words which its speaker says in training too; a shorter record is one span."""
    train, ev = _splits(spark, sf)
    return span_coverage(train, ev)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return token_ids(table(spark, sf, "documents"), "doc_id", F.col("text"))


def p8_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens per source."""
    n = token_ids(table(spark, sf, "documents"), "doc_id", F.col("text"), counts=True, keep={"source": F.col("source")})
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_coverage": p1_coverage, "p8_ids": p8_ids, "p8_tokens_by_source": p8_tokens_by_source}
_PAIRS = """
with r as (
  select utt_id, split, dataset, regexp_extract(lower(replace(audio_path, '\\', '/')), '([^/]+?)(\\.[a-z0-9]{1,5})?$', 1) as file,
    right(regexp_replace(lower(regexp_replace(client_id, '^.*[/:_]', '')), '[^0-9a-f]', '', 'g'), 16) as speaker,
    trim(regexp_replace(replace(replace(replace(replace(lower(nfc_normalize(sentence)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')) as words
  from (select *, 'train' as split from merged_train union all by name select *, 'valid' as split from merged_valid union all by name select *, 'test' as split from merged_test)),
pairs as (
  select a.utt_id as train_id, b.utt_id as eval_id from r a join r b on a.file = b.file and a.dataset = b.dataset
  where a.split = 'train' and b.split <> 'train' and a.file not in ('', 'nan')
  union
  select a.utt_id, b.utt_id from r a join r b on a.speaker = b.speaker
  where a.split = 'train' and b.split <> 'train' and length(a.speaker) = 16 and a.words not in ('', 'nan', 'none', 'null') and b.words not in ('', 'nan', 'none', 'null')
    and (a.words = b.words or abs(length(a.words) - length(b.words)) <= 2
      and regexp_replace(a.words, '[^0-9 ]', '', 'g') = regexp_replace(b.words, '[^0-9 ]', '', 'g') and levenshtein(a.words, b.words) <= 2))
"""
SQL = {
    "p1_found": _PAIRS + "select least(train_id, eval_id) as utt_id_a, greatest(train_id, eval_id) as utt_id_b from pairs",
    "p1_coverage": _PAIRS
    + """, t as (select utt_id, split, speaker, string_split(words, ' ') as w from r where length(speaker) = 16 and words not in ('', 'nan', 'none', 'null')),
g as (select utt_id, split, speaker, len(w) as words, i, array_to_string(w[i + 1:i + 5], ' ') as span from (select *, unnest(range(0, len(w) - 4)) as i from t where len(w) >= 5)),
h as (select * from g where split <> 'train' and (speaker, span) in (select (speaker, span) from g where split = 'train')),
k as (select e.utt_id, len(e.w) as words from t e where e.split <> 'train' and len(e.w) < 5 and exists (
  select 1 from t x where x.split = 'train' and x.speaker = e.speaker and contains(' ' || array_to_string(x.w, ' ') || ' ', ' ' || array_to_string(e.w, ' ') || ' ')))
select utt_id, words::integer as words, count(distinct pos)::integer as covered from (select utt_id, words, unnest(range(i, i + 5)) as pos from h) group by all
union all select utt_id, words::integer, words::integer from k""",
    "p1_report": _PAIRS
    + """, hits as (select eval_id, count(*) as n from pairs group by all)
select split, dataset, count(*) as records, count(n) as leaked, cast(coalesce(sum(n), 0) as bigint) as pairs
from r left join hits on eval_id = utt_id where split <> 'train' group by all""",
}
