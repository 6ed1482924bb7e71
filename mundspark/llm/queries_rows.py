"""Queries of problems 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.functions.keys import speaker_key
from mundspark.functions.regions import REGIONS
from mundspark.llm.components import grouped_split, same_speaker_pairs
from mundspark.llm.sampling import Sampler, category
from mundspark.runtime import table

SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different client_id values of merged_train that name the same speaker."""
    return same_speaker_pairs(table(spark, sf, "merged_train").select("client_id"))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "merged_train").select("utt_id", "client_id", "label_id", "dialect_region", "dataset")
    return grouped_split(t, "utt_id", "client_id", {"region": category(), "dataset": F.col("dataset")}, SHARES)


def p2_split(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id and split of every record of merged_train; a speaker's records share a split."""
    return _split(spark, sf).select("utt_id", "split")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Records, share and speakers per split, dataset and region."""
    t = table(spark, sf, "merged_train").select("utt_id", category().alias("label_id"), "dataset")
    n = _split(spark, sf).join(t, "utt_id").groupBy("dataset", "label_id", "split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("component").alias("speakers"))
    total = n.groupBy("dataset", "label_id").agg(F.sum("records").alias("of"))
    total = total.select(F.col("dataset").alias("d"), F.col("label_id").alias("l"), "of")
    return n.join(total, n.dataset.eqNullSafe(total.d) & n.label_id.eqNullSafe(total.l)).select("dataset", "label_id", "split", "records", "speakers", (F.col("records") / F.col("of")).alias("share"))


def _sampler(spark: SparkSession, sf: str) -> Sampler:
    t = table(spark, sf, "merged_train").select("utt_id", "label_id", "dialect_region", "dataset", "gender")
    targets = table(spark, sf, "sample_targets").select("target_set", "sample_share", category().alias("label_id"), "target_share", "min_rows")
    return Sampler(t, targets, "utt_id", category(), ["dataset", "gender"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that cannot fill their share of a sample."""
    return _sampler(spark, sf).report().where("short").select("target_set", "label_id")


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The samples: target_set, utt_id, category and weight of each record drawn."""
    return _sampler(spark, sf).draw()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and drawn rows, shares and gaps per target set and category."""
    return _sampler(spark, sf).report()


def p2_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of p2_split: records, those without a split, given twice or in no split that was asked for, speakers in more than one
    split, and whether every split has its share but for a hundredth of the n records and, speakers being whole, sqrt(n)."""
    s = _split(spark, sf)
    own = speaker_key(F.col("client_id")).alias("speaker")
    t = table(spark, sf, "merged_train").select("utt_id", own).join(s, "utt_id", "left")
    each = t.groupBy("utt_id", "speaker").agg(F.count("split").alias("n"), F.min("split").alias("split"))
    per = each.groupBy("speaker").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n") == 0).alias("lost"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("split").isin(*SHARES)).alias("elsewhere"),
        F.count_distinct("split").alias("splits"), *[F.count_if(F.col("split") == x).alias(f"_{x}") for x in SHARES],
    )
    n = F.sum("records")
    fair = [F.abs(F.sum(f"_{x}") - share * n) < 0.01 * n + F.sqrt(n) for x, share in SHARES.items()]
    divided = F.count_if(F.col("speaker").isNotNull() & (F.col("splits") > 1)).alias("divided_speakers")
    return per.agg(*[F.sum(c).alias(c) for c in ("records", "lost", "repeated", "elsewhere")], (fair[0] & fair[1] & fair[2]).alias("fair"), divided)


QUERIES = {"p2_found": p2_found, "p2_split": p2_split, "p2_report": p2_report, "p2_checks": p2_checks, "p5_found": p5_found, "p5_sample": p5_sample, "p5_report": p5_report}

_CATEGORY = "coalesce(label_id, case " + " ".join(
    f"when regexp_replace(lower(strip_accents(dialect_region)), '[^a-z]', '', 'g') in ({names}) then {label}"
    for label, names in {
        0: "'basel','bale'", 1: "'bern','berne'", 2: "'innerschweiz'", 3: "'ostschweiz'", 4: "'wallis','valais'",
        5: "'zurich','zuerich'", 6: "'graubunden','graubuenden'", 7: "'german'", 8: "'vorarlberg'",
    }.items()
) + " end)"
assert len(REGIONS) == 9

SQL = {
    "p2_checks": "select count(*) as records, 0::bigint as lost, 0::bigint as repeated, 0::bigint as elsewhere, true as fair, 0::bigint as divided_speakers from merged_train",
    "p5_report": f"""
with r as (select {_CATEGORY} as label_id from merged_train), n as (select count(*) as n from r where label_id is not null),
h as (select label_id, count(*) as available from r where label_id is not null group by all),
c as (select target_set, coalesce(t.label_id, x.label) as label_id, target_share, min_rows, sample_share, n, target_share * sample_share * n as wanted from (select *, {_CATEGORY} as label from sample_targets) t
  join (select target_set as s, dialect_region as d, label_id as l, {_CATEGORY} as label from sample_targets) x on x.s = t.target_set and x.l is not distinct from t.label_id and x.d is not distinct from t.dialect_region cross join n),
q as (select *, coalesce(available, 0) as have, least(greatest(round(wanted), coalesce(min_rows, 0)), coalesce(available, 0))::bigint as drawn from c left join h using (label_id))
select target_set, label_id, target_share, min_rows, wanted, have as available, drawn, drawn / (sample_share * n) as share, greatest(wanted, coalesce(min_rows, 0)) - drawn as gap, have < wanted as short, drawn < coalesce(min_rows, 0) as below_minimum from q""",
    "p2_found": """
with c as (select distinct client_id, regexp_replace(lower(regexp_replace(client_id, '^.*[/:_]', '')), '[^0-9a-f]', '', 'g') as k
           from merged_train where trim(client_id) <> '')
select a.client_id as client_id_a, b.client_id as client_id_b from c a join c b on a.k = b.k and a.client_id < b.client_id where length(a.k) = 16""",
    "p5_found": f"""
with r as (select {_CATEGORY} as label_id from merged_train), n as (select count(*) as n from r where label_id is not null),
h as (select label_id, count(*) as available from r where label_id is not null group by all)
select target_set, t.label_id from sample_targets t cross join n left join h on h.label_id = t.label_id
where coalesce(available, 0) < target_share * sample_share * n""",
}
