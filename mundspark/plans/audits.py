"""Queries that choose, compare and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import file_key
from mundspark.operators import features, models, rows, selection
from mundspark.operators.transcript import chunked, islands, with_previous
from mundspark.plans.speech import _CLIPS, _DROP, _HELD, _OWNER, _arrays, _clips, _gram_sql, _owners, _stage_sql
from mundspark.runtime import staged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {_CLIPS}, g as ({_gram_sql(features.SIZES)}), n as (select p.label, term, count(*) as n from g join p using (doc) where p.label is not null group by all),
r as (select *, row_number() over (partition by label order by n desc, term) as t, row_number() over (partition by label order by n, term) as b from n)
select label, term, n, t as rank, 'top' as side from r where t <= 10 union all select label, term, n, b, 'bottom' from r where b <= 10""")
def class_terms(spark, sf):
    """The ten most and least frequent phoneme 2- to 4-grams of each label."""
    clips = _clips(spark, sf).where("label is not null")
    grams = features.ngrams("_t", features.SIZES)
    n = clips.select("label", features.tokens(F.col("phoneme"), drop=_DROP).alias("_t")).select("label", F.explode(grams).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    return selection.top_and_bottom(staged(n, "class-terms"), "label", "n", "term", 10).withColumn("rank", F.col("rank").cast("long"))


@query("""with s as (select trim(client_id) as client_id, avg(case when label_id = 7 then 1.0 else 0.0 end) as p, count(*) as n from merged_train where trim(client_id) <> '' and label_id is not null group by 1)
select * from s order by abs(p - 0.5), md5('42|' || client_id), client_id limit 20""")
def uncertain_speakers(spark, sf):
    """The 20 speakers whose share of German utterances is nearest to a half."""
    t = table(spark, sf, "merged_train").select(F.trim("client_id").alias("client_id"), "label_id").where("client_id <> '' and label_id is not null")
    s = t.groupBy("client_id").agg(F.avg((F.col("label_id") == 7).cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    return selection.most_uncertain(s, "p", "client_id", 20)


@query("""with x as (select label, unnest(embedding)::double as x, unnest(range(0, len(embedding))) as dim from embeddings), g as (select dim, label, count(*) as n, avg(x) as m, var_pop(x) as v from x group by all),
a as (select *, sum(n * m) over (partition by dim) / sum(n) over (partition by dim) as o from g)
select cast(dim as int) as dim, round((sum(n * (m - o) * (m - o)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) as f from a group by dim""")
def embedding_anova(spark, sf):
    """How much each dimension of the embeddings differs between labels."""
    return selection.anova(table(spark, sf, "embeddings"), "embedding", "label").withColumn("f", F.round("f", 5))


@query("""with c as (select gender as a, dataset as b, count(*) as n from merged_train where gender is not null and dataset is not null group by all)
select round(sum(n / t * ln(n * t / (x * y))), 8) as information from (select n, sum(n) over () as t, sum(n) over (partition by a) as x, sum(n) over (partition by b) as y from c)""")
def gender_dataset_information(spark, sf):
    """Mutual information of gender and dataset."""
    return selection.mutual_information(table(spark, sf, "merged_train"), F.col("gender"), F.col("dataset")).withColumn("information", F.round("information", 8))


@query("""with a as (select distinct episode_id as k from episodes), b as (select distinct episode_id as k from transcript_segments)
select (select count(*) from a) as in_a, (select count(*) from b) as in_b, (select count(*) from a join b using (k)) as in_both, (select count(*) from a where k not in (select k from b)) as only_a, (select count(*) from b where k not in (select k from a)) as only_b""")
def episode_coverage(spark, sf):
    """Episodes that the manifest and the transcripts have."""
    return selection.coverage(table(spark, sf, "episodes"), table(spark, sf, "transcript_segments"), "episode_id")


_LATEST = "e as (select * from (select *, row_number() over (partition by episode_id order by processed_at desc nulls first) as r from episodes) where r = 1)"


@query(f"""with {_LATEST}, s as (select episode_id, count(*) as segments, count(distinct speaker) as speakers, max(case when cast("end" as varchar) <> 'nan' then "end" end) as last_end from transcript_segments group by all)
select e.episode_id, e.podcast, coalesce(segments, 0) as segments, coalesce(speakers, 0) as labels, coalesce(abs(last_end - duration_sec) > 1.0, true) as mismatch from e left join s using (episode_id)""")
def episode_segments(spark, sf):
    """Each episode's latest manifest row with its segments, and whether its duration disagrees with their last end."""
    e = rows.last_row(table(spark, sf, "episodes"), ["episode_id"], [F.col("processed_at").isNull(), F.col("processed_at")])
    end = F.max(F.nanvl(F.col("end"), F.lit(None).cast("double")))
    s = table(spark, sf, "transcript_segments").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("speaker").alias("labels"), end.alias("last_end"))
    mismatch = C.duration_mismatch(F.lit(0.0), F.col("last_end"), F.col("duration_sec"), 1.0)
    return e.join(s, "episode_id", "left").select("episode_id", "podcast", F.coalesce("n", F.lit(0)).alias("segments"), F.coalesce("labels", F.lit(0)).alias("labels"), mismatch.alias("mismatch"))


@query("""with x as (select user_id, ts, event_id, value, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
i as (select *, sum(case when p is null or epoch(ts) - epoch(p) > 1800 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session from x)
select user_id, session::bigint as session, count(*) as events, round(sum(value), 4) as total, min(event_id) as first_id from i group by all""")
def user_sessions(spark, sf):
    """Events of a user no more than half an hour apart."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    d = with_previous(chunked(e, "at", 86_400.0), "user_id", ["at", "event_id"], ["at"])
    d = islands(d, "user_id", ["at", "event_id"], F.col("_prev").isNull() | (F.col("at") - F.col("_prev.at") > 1800), "session")
    return d.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first_id"))


@query("""select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 5) as mean, sum(cast(props->>'$.k' as bigint))::bigint as k from events group by all""")
def event_properties(spark, sf):
    """Events by type, with a number from their JSON properties."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 5).alias("mean"), F.sum(k).alias("k"))


@query()
def embedding_probe(spark, sf):
    """Scores of a logistic regression on the embeddings over five stratified folds."""
    return models.probe(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")


@query(f"""with {_CLIPS}, g as ({_gram_sql(features.SIZES)}), c as (select doc, term, count(*) as tf from g group by all), {_OWNER}, h as (select doc from p join o using (doc) where label is not null),
{_stage_sql("b", "true", "(label = 7)::int", "h").replace(f"not {_HELD} and ", "")},
r as (select grp, count(*) as docs, avg(p) as mean, median(p) as median, max(p) as most from bp join o using (doc) where label = 1 group by grp)
select grp as "group", docs, round(mean, 5) as mean, round(median, 5) as median, round(most, 5) as most, (mean >= 0.5)::int as by_mean, (median > 0.4)::int as by_median from r""")
def speaker_probabilities(spark, sf):
    """Mean, median and largest probability of High German over each speaker's clips."""
    clips, arrays = _arrays(spark, sf, True)
    docs = features.label_counts(clips)
    counts = staged(features.class_counts(features.in_rows(arrays, "label"), list(docs)), "class-counts")
    nb = features.NaiveBayes.of(counts, docs, {0: [x for x in docs if x != 7], 1: [x for x in docs if x == 7]})
    owner = staged(_owners(spark, sf), "owners")
    mine = arrays.join(owner.select("doc"), "doc", "left_semi")
    s = features.probability_summary(nb.probabilities(features.in_rows(mine, "doc"), mine.select("doc")), owner)
    by = {f"by_{r}": C.decision(F.col("mean"), F.col("median"), r).alias(f"by_{r}") for r in ("mean", "median")}
    return s.select("group", "docs", *[F.round(c, 5).alias(c) for c in ("mean", "median", "most")], *by.values())
