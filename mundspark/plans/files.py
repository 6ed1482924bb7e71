"""Queries that go through the readers, writers and streams, and the audits that compare tables with their sources.

The tables are written to the session's shared folder by the engine's writers and read back by its readers; the SQL asks the
tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import file_key
from mundspark.operators import metrics, reports, rows
from mundspark.operators.features import NaiveBayes
from mundspark.plans.speech import _FILE
from mundspark.runtime import scratch, table
from mundspark.sources import delimited, sinks
from mundspark.streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _written(spark, sf, name: str, *cols: str, sep: str = "\t") -> str:
    path = scratch(spark, "file")
    sinks.write_delimited(table(spark, sf, name).select(*cols), path, sep)
    return path


@query("select cast(utt_id as varchar) as utt_id, coalesce(sentence, '') as sentence, coalesce(client_id, '') as client_id from merged_train")
def strings_read(spark, sf):
    """A delimited table written and read back as texts, NULL as the empty text."""
    return delimited.read_strings(spark, _written(spark, sf, "merged_train", "utt_id", "sentence", "client_id"))


@query("""select utt_id, case when s = '' then null else s end as dataset, case when g in ('', 'NA', 'nan', 'NaN', 'null', 'NULL', 'None', 'N/A', 'n/a', 'NAN', '<NA>', '#N/A') then null else g end as gender
from (select cast(utt_id as varchar) as utt_id, coalesce(dataset, '') as s, coalesce(gender, '') as g from merged_train)""")
def missing_read(spark, sf):
    """The same with blanks and missing-value tokens as NULL."""
    return delimited.read_strings(spark, _written(spark, sf, "merged_train", "utt_id", "dataset", "gender"), missing=True)


@query("""select cast(utt_id as varchar) as utt_id, upper(trim(coalesce(canton, ''), ' ' || chr(9) || chr(160))) as canton, trim(coalesce(zipcode, ''), ' ' || chr(9) || chr(160)) as zipcode from merged_train""")
def utterances_read(spark, sf):
    """Utterances read back with every column stripped and cantons in capitals."""
    return delimited.read_utterances(spark, _written(spark, sf, "merged_train", "utt_id", "canton", "zipcode"))


@query("select utt_id, label_id, duration from merged_train")
def typed_read(spark, sf):
    """A table read back with its types."""
    return delimited.read_typed(spark, _written(spark, sf, "merged_train", "utt_id", "label_id", "duration"), "utt_id long, label_id int, duration double")


@query("select cast(utt_id as varchar) as utt_id, coalesce(sentence_source, '') as sentence_source, coalesce(dataset, '') as dataset from merged_valid")
def sniffed_read(spark, sf):
    """A table with semicolons, whose delimiter is found from its first line."""
    return delimited.read_sniffed(spark, _written(spark, sf, "merged_valid", "utt_id", "sentence_source", "dataset", sep=";"))


@query("select cast(utt_id as varchar) as utt_id, coalesce(dataset, '') as dataset from merged_train")
def columns_read(spark, sf):
    """Two of the columns of a written table; the reader parses no others."""
    return delimited.read_columns(spark, _written(spark, sf, "merged_train", "utt_id", "sentence", "dataset", "path"), ["dataset", "utt_id", "absent"])


@query("select cast(utt_id as varchar) as utt_id, coalesce(dataset, '') as dataset, coalesce(cast(label_id as varchar), '') as label_id from merged_train")
def unquoted_read(spark, sf):
    """A table written without quotes, and read so that quotes mean nothing."""
    path = scratch(spark, "file")
    t = table(spark, sf, "merged_train").select("utt_id", "dataset", "label_id")
    head = spark.createDataFrame([("utt_id\tdataset\tlabel_id",)], "value string")
    sinks.write_unquoted(t, path)
    head.coalesce(1).write.mode("append").text(f"{path}-head")
    return delimited.read_unquoted(spark, [f"{path}-head", path])


@query("select 'valid' as run, count(*) as lines from merged_valid union all select 'both', (select count(*) from merged_valid) + (select count(*) from merged_test)")
def manifest_lines(spark, sf):
    """Lines of a manifest after one run and after two."""
    path, out = scratch(spark, "manifest"), []
    for run, name in (("valid", "merged_valid"), ("both", "merged_test")):
        sinks.append_manifest(table(spark, sf, name).select("utt_id", "dataset"), path)
        out.append((run, delimited.read_strings(spark, path, ",").count()))
    return spark.createDataFrame(out, "run string, lines long")


@query("select label_id, count(*) as n, min(utt_id) as first_id from merged_train where label_id is not null group by all")
def folders_by_label(spark, sf):
    """Rows written to a folder for each label and read back."""
    path = scratch(spark, "labels")
    sinks.write_by_label(table(spark, sf, "merged_train").where("label_id is not null").select("utt_id", "label_id"), path, "label_id", list(range(12)))
    t = spark.read.csv(path, sep="\t", header=True, schema="utt_id long, label_id int")
    return t.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"), F.min("utt_id").alias("first_id"))


@query("select episode_id, count(*) as segments, count(text) as texts, count(distinct speaker) as speakers from transcript_segments group by all")
def transcripts_written(spark, sf):
    """Segments written as one JSON line an episode and read back."""
    path = scratch(spark, "transcripts")
    sinks.write_transcripts(table(spark, sf, "transcript_segments"), path, "episode_id")
    t = spark.read.schema("episode_id long, segments array<struct<start: double, end: double, speaker: string, text: string, overlap_coverage: double>>").json(path)
    s = t.select("episode_id", F.explode("segments").alias("s"))
    return s.groupBy("episode_id").agg(F.count(F.lit(1)).alias("segments"), F.count("s.text").alias("texts"), F.count_distinct("s.speaker").alias("speakers"))


@query("select count(*) as rows, count(*) as blank from merged_valid")
def labels_to_fill(spark, sf):
    """A template for labelling by people: all rows, no label."""
    path = scratch(spark, "template")
    sinks.label_template(table(spark, sf, "merged_valid").select("utt_id", "sentence"), path, ["utt_id", "sentence"])
    t = delimited.read_strings(spark, path, ",")
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == "").alias("blank"))


@query("select count(*) as n, round(sum(list_sum(list_transform(embedding, lambda x: x::double))), 4) as total from embeddings")
def features_written(spark, sf):
    """Embeddings written in files of bounded size and read back."""
    path = scratch(spark, "features")
    sinks.write_features(table(spark, sf, "embeddings").select("vec_id", "embedding"), path, 200)
    t = spark.read.parquet(path)
    return t.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))), 4).alias("total"))


@query("""select x.label_id as label, round(ln((n + 0.1) / (sum(n) over () + 0.1 * count(*) over ())), 6) as weight from (select label_id, count(*) as n from merged_train where label_id is not null group by all) x""")
def bayes_reloaded(spark, sf):
    """Likelihoods of a saved and reloaded naive Bayes model, whose terms are the labels themselves."""
    t = table(spark, sf, "merged_train").where("label_id is not null").select(F.col("label_id").alias("term"), F.lit(0).alias("label"), F.lit(1).cast("long").alias("tf"), F.col("utt_id").alias("doc"))
    path = scratch(spark, "bayes")
    sinks.save_bayes(NaiveBayes.fit(t.select("doc", "term", "tf"), t.select("doc", "label"), min_df=1), path)
    return sinks.load_bayes(spark, path).terms.select(F.col("term").alias("label"), F.round(F.col("ll")[0], 6).alias("weight"))


def _events(spark, sf):
    t = table(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    names = spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return names.withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(stream, mode: str):
    """All that a stream over the whole table sends, written to the shared folder."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def keep(df, _):
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("select user_id, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, max(value) as most from events group by all")
def streamed_summaries(spark, sf):
    """Running summaries of each user after the whole stream."""
    s = _streamed(sessions.summaries(_events(spark, sf), "user_id", "value"), "complete")
    return s.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "most")


@query("""select cast(time_bucket(interval '1 day', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def streamed_windows(spark, sf):
    """Daily counts and totals of each kind of event, of the whole stream."""
    s = _streamed(sessions.windowed(_events(spark, sf), "ts", "1 day", "3650 days", "event_type", "value"), "complete")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""with m as (select distinct {_FILE} as file from merged_train where trim(audio_path) <> ''), s as (select distinct label_id, {_FILE} as file from train_phonemes where trim(audio_path) <> '')
select label_id, count(*) as source, count(*) filter (file in (select file from m)) as kept, count(*) filter (file not in (select file from m)) as dropped from s where file not in ('', 'nan', 'none', 'null') group by all""")
def drop_reconciliation(spark, sf):
    """Clips of the phoneme table per label, those that the merged utterances have, and those dropped."""
    source, merged = (table(spark, sf, t).withColumn("file", file_key(F.col("audio_path"))) for t in ("train_phonemes", "merged_train"))
    return reports.reconcile(source, merged, "file", "label_id")


@query("""with a as (select 'utterances' as source, dataset as part, count(*) as n from merged_train group by all union all select 'documents', source, count(*) from documents group by all)
select source, part, n, round(100 * n / sum(n) over (partition by source), 2) as pct from a""")
def source_sizes(spark, sf):
    """Rows of every part of two merged tables, with their shares."""
    part = lambda t, c, name: table(spark, sf, t).groupBy(F.col(c).alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
    a = part("merged_train", "dataset", "utterances").unionByName(part("documents", "source", "documents"))
    total = a.groupBy("source").agg(F.sum("n").alias("of"))
    return a.join(total, "source").select("source", "part", "n", F.round(100 * F.col("n") / F.col("of"), 2).alias("pct"))


@query("""select count(*) as rows, sha256(string_agg(coalesce(audio_path, '') || chr(9) || coalesce(sentence, '') || chr(9) || coalesce(cast(label_id as varchar), '') || chr(10), '' order by encode(coalesce(audio_path, '') || chr(9) || coalesce(sentence, '') || chr(9) || coalesce(cast(label_id as varchar), '')))) as digest from merged_test""")
def evaluation_fingerprint(spark, sf):
    """SHA-256 over the sorted lines of path, sentence and label of the test split."""
    return reports.line_fingerprint(table(spark, sf, "merged_test"), ["audio_path", "sentence", "label_id"])


@query("""select coalesce(podcast, '') || '__' || episode_id || '__' || coalesce(nullif(regexp_extract(speaker, '([0-9]+)', 1), ''), 'unknown') as speaker_key, count(*) as segments from transcript_segments group by all""")
def composite_speakers(spark, sf):
    """Segments of each podcast, episode and speaker, under one composite key."""
    who = F.coalesce(F.nullif(F.regexp_extract("speaker", "([0-9]+)", 1), F.lit("")), F.lit("unknown"))
    key = F.concat_ws("__", F.coalesce("podcast", F.lit("")), F.col("episode_id").cast("string"), who)
    return table(spark, sf, "transcript_segments").groupBy(key.alias("speaker_key")).agg(F.count(F.lit(1)).alias("segments"))


@query("""with a as (select podcast, episode_id, speaker, count(*) as n from transcript_segments where speaker is not null and podcast is not null group by all having count(*) >= 10)
select s.segment_id, s.podcast, s.episode_id, s.speaker, a.n from transcript_segments s join a on a.podcast = s.podcast and a.episode_id = s.episode_id and a.speaker = s.speaker""")
def assigned_segments(spark, sf):
    """Segments of speakers that an episode has ten times or more, joined on three keys; others are left out."""
    s = table(spark, sf, "transcript_segments").select("segment_id", "podcast", "episode_id", "speaker")
    a = s.groupBy("podcast", "episode_id", "speaker").agg(F.count(F.lit(1)).alias("n")).where("n >= 10 and podcast is not null and speaker is not null")
    return s.join(a, ["podcast", "episode_id", "speaker"])


@query("""with e as (select episode_id, max(duration_sec) as duration_sec from episodes group by all)
select episode_id, cast((row_number() over (order by duration_sec desc nulls last, episode_id) - 1) % 8 as integer) as worker from e""")
def longest_first(spark, sf):
    """Episodes dealt to eight workers, the longest first."""
    e = table(spark, sf, "episodes").groupBy("episode_id").agg(F.max("duration_sec").alias("duration_sec"))
    return rows.deal_longest_first(e, "duration_sec", "episode_id", 8).select("episode_id", "worker")


@query(r"""select utt_id, left(regexp_replace(trim(regexp_replace(sentence, '[<>:"/\\|?*]', '', 'g'), ' '), '[ \t\n\r]+', '_', 'g'), 40) as name, coalesce(regexp_matches(trim(age), '^[+-]?[0-9.]*$') and trim(age) <> '', false) as numeric_age,
  case when starts_with(audio_path, '/') then audio_path else '/data/' || dataset || '/' || audio_path end as absolute, nullif(list_extract(string_split(replace(audio_path, '\', '/'), '/'), -2), '') as folder from merged_train""")
def clip_columns(spark, sf):
    """File names made of sentences, numbers in the age, absolute paths and folders of the clips."""
    p = F.col("audio_path")
    return table(spark, sf, "merged_train").select(
        "utt_id", C.safe_name(F.col("sentence"), 40).alias("name"), C.number_like(F.col("age")).alias("numeric_age"),
        F.when(p.isNotNull() & (p.startswith("/") | F.col("dataset").isNotNull()), C.absolute_path(p, F.concat(F.lit("/data/"), "dataset"))).alias("absolute"), C.path_part(p, 2).alias("folder"),
    )


@query("""select dataset as model, count(*) as n, round(avg(case when isnan(duration) then null else duration end), 6) as duration, round(avg(label_id), 6) as label_id, round(100 * count(*) filter (label_id <> 7) / count(*), 4) as dialect_pct from merged_train group by all""")
def model_means(spark, sf):
    """Mean scores and share of dialect per model, with data sets for models."""
    t = table(spark, sf, "merged_train").select(F.col("dataset").alias("model"), "duration", "label_id")
    s = metrics.model_summary(t, "model", F.col("label_id") != 7, "duration", "label_id")
    return s.select("model", "n", *[F.round(c, 6).alias(c) for c in ("duration", "label_id")], F.round("dialect_pct", 4).alias("dialect_pct"))
