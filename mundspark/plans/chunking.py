"""Queries of the greedy chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import speaker_key
from mundspark.operators.chunks import chunk_documents, cycled, greedy_chunks
from mundspark.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _recursive(items: str, target: float, policy: str) -> str:
    """items selects k, o (number within k), d; the result is the relation `c` of k, o, d, chunk."""
    new = f"c.acc + i.d > {target}" if policy == "pre" else f"c.acc >= {target}"
    return f"""with recursive i as ({items}), c as (
  select k, o, d, d as acc, 0::bigint as chunk from i where o = 1
  union all select i.k, i.o, i.d, case when {new} then i.d else c.acc + i.d end, c.chunk + case when {new} then 1 else 0 end from c join i on i.k = c.k and i.o = c.o + 1)"""


_EVENTS = "select user_id as k, row_number() over (partition by user_id order by ts, event_id) as o, value as d from events"


@query(_recursive(_EVENTS, 300, "pre") + " select k as user_id, count(distinct chunk) as chunks, count(*) as items, round(sum(d), 4) as total from c group by k")
def chunk_rollup(spark, sf):
    """Chunks of at most 300 of each user's events in order, rolled up per user."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    c = greedy_chunks(e, ["user_id"], ["ts", "event_id"], F.col("value"), 300.0)
    return c.groupBy("user_id").agg((F.max("chunk") + 1).alias("chunks"), F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 4).alias("total"))


@query(_recursive(_EVENTS, 300, "post") + " select k as user_id, chunk, count(*) as items, round(sum(d), 4) as total from c group by k, chunk")
def chunk_post(spark, sf):
    """Chunks that end once they reach 300."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    c = greedy_chunks(e, ["user_id"], ["ts", "event_id"], F.col("value"), 300.0, "post")
    return c.groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 4).alias("total"))


def _utterances(spark, sf):
    t = table(spark, sf, "merged_train").select(speaker_key(F.col("client_id")).alias("speaker"), "audio_path", "utt_id", "sentence", "duration")
    d = C.seconds(F.col("duration"))
    return t.where("speaker is not null").withColumn("_d", F.when(d > 0, d).otherwise(5.0))


_SPEAKER = "regexp_extract(regexp_replace(lower(regexp_replace(trim(client_id), '^.*[/:_]', '')), '[^0-9a-f]', '', 'g'), '([0-9a-f]{16})$', 1)"
_SECONDS = "greatest(case when duration is null or (cast(duration as varchar) = 'nan') then 0 else duration end, 0)"
_UTT = f"""select k, row_number() over (partition by k order by audio_path nulls first, utt_id) as o, case when s > 0 then s else 5.0 end as d from (
  select {_SPEAKER} as k, audio_path, utt_id, {_SECONDS} as s from merged_train) where k <> ''"""


@query(_recursive(_UTT, 90, "pre") + " select k as speaker, chunk, count(*) as items, round(sum(d), 3) as total from c group by k, chunk")
def speaker_chunks(spark, sf):
    """Chunks of at most 90 s of each speaker's utterances, by path; utterances without a duration count 5 s."""
    c = greedy_chunks(_utterances(spark, sf), ["speaker"], ["audio_path", "utt_id"], F.col("_d"), 90.0)
    return c.groupBy("speaker", "chunk").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("_d"), 3).alias("total"))


@query(_recursive(_UTT, 90, "pre") + " select k as speaker, count(*) as items, round(sum(d), 3) as total from c where chunk = 0 group by k having count(*) >= 3")
def first_chunks(spark, sf):
    """The first chunk of each speaker, if it has at least three utterances."""
    c = greedy_chunks(_utterances(spark, sf), ["speaker"], ["audio_path", "utt_id"], F.col("_d"), 90.0).where("chunk = 0")
    return c.groupBy("speaker").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("_d"), 3).alias("total")).where("items >= 3")


_TEXTS = f"""select k, row_number() over (partition by k order by audio_path nulls first, utt_id) as o, sentence from (
  select {_SPEAKER} as k, audio_path, utt_id, sentence from merged_train) where k <> ''"""


@query(_recursive(_UTT, 90, "pre") + f""", t as ({_TEXTS})
select k as speaker, chunk, count(*) as items, round(sum(d), 3) as total, coalesce(string_agg(sentence, ' ' order by o) filter (trim(sentence, ' ') <> ''), '') as document from c join t using (k, o) group by k, chunk""")
def chunk_texts(spark, sf):
    """The chunks as documents."""
    c = greedy_chunks(_utterances(spark, sf), ["speaker"], ["audio_path", "utt_id"], F.col("_d"), 90.0)
    return chunk_documents(c, ["speaker"], ["audio_path", "utt_id"], text="sentence").withColumn("total", F.round("total", 3))


@query()
def cycled_documents(spark, sf):
    """Documents of about 30 s for each speaker, short ones filled by repeating their utterances."""
    t = _utterances(spark, sf).withColumn("_s", C.seconds(F.col("duration")))
    return cycled(t, ["speaker"], ["audio_path", "utt_id"], F.col("_s"), "sentence", 30.0)
