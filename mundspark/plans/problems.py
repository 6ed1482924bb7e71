"""Queries of the problems that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.operators.intervals import periods_and_gaps, to_ms
from mundspark.runtime import table


def _segment_ms(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "transcript_segments")
    return s.select("episode_id", to_ms(F.col("start")).alias("start_ms"), to_ms(F.col("end")).alias("end_ms"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of speech and gaps between them, per episode, in whole milliseconds."""
    r = periods_and_gaps(_segment_ms(spark, sf), "episode_id", "start_ms", "end_ms")
    return r.select(F.col("entity").alias("episode_id"), "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Per episode: number of periods and gaps, covered and silent time, longest gap."""
    r = p3_found(spark, sf).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    p, g = F.col("kind") == "period", F.col("kind") == "gap"
    return r.groupBy("episode_id").agg(
        F.count_if(p).alias("periods"),
        F.count_if(g).alias("gaps"),
        F.sum(F.when(p, F.col("ms")).otherwise(0)).alias("covered_ms"),
        F.sum(F.when(g, F.col("ms")).otherwise(0)).alias("silent_ms"),
        F.coalesce(F.max(F.when(g, F.col("ms"))), F.lit(0)).alias("longest_gap_ms"),
    )


_P3 = """
with i as (
  select episode_id, cast(round(start * 1000) as bigint) as s, cast(round("end" * 1000) as bigint) as e
  from transcript_segments where start is not null and not (cast(start as varchar) = 'nan') and "end" is not null and not (cast("end" as varchar) = 'nan')
), v as (select * from i where e > s),
f as (select *, max(e) over (partition by episode_id order by s, e rows between unbounded preceding and 1 preceding) as far from v),
r as (select *, sum(case when far is null or s > far then 1 else 0 end) over (partition by episode_id order by s, e rows unbounded preceding) as run from f),
p as (select episode_id, run, min(s) as s, max(e) as e from r group by all),
g as (select *, lag(e) over (partition by episode_id order by s) as prev from p),
found as (
  select episode_id, 'period' as kind, s as start_ms, e as end_ms from g
  union all select episode_id, 'gap', prev, s from g where prev is not null)
"""

QUERIES = {"p3_found": p3_found, "p3_coverage": p3_coverage}

SQL = {
    "p3_found": _P3 + "select * from found",
    "p3_coverage": _P3
    + """select episode_id, count(*) filter (kind = 'period') as periods, count(*) filter (kind = 'gap') as gaps,
  cast(sum(case when kind = 'period' then end_ms - start_ms else 0 end) as bigint) as covered_ms,
  cast(sum(case when kind = 'gap' then end_ms - start_ms else 0 end) as bigint) as silent_ms,
  coalesce(max(case when kind = 'gap' then end_ms - start_ms end), 0) as longest_gap_ms
from found group by episode_id""",
}
