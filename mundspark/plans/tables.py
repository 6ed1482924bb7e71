"""Queries over the utterance tables: normalising, choosing, joining, reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import file_key
from mundspark.functions.normalise import NOTHING_TO_SAY, PUNCTUATION, for_synthesis, words_only
from mundspark.functions.regions import REGIONS, region_label
from mundspark.operators import reports, rows
from mundspark.runtime import table
from mundspark.schemas import conform

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _all(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    out = None
    for s in ("train", "valid", "test"):
        t = table(spark, sf, f"merged_{s}").select(*cols, F.lit(s).alias("split"))
        out = t if out is None else out.unionByName(t)
    return out


_ALL = """(select *, 'train' as split from merged_train union all by name select *, 'valid' as split from merged_valid
  union all by name select *, 'test' as split from merged_test)"""


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


@query(f"""select utt_id, coalesce(trim(sentence, {_WS}), '') as sentence, coalesce(trim(client_id, {_WS}), '') as client_id,
  upper(coalesce(trim(canton, {_WS}), '')) as canton, coalesce(trim(zipcode, {_WS}), '') as zipcode, cast(label_id as integer) as label_id from merged_train""")
def conform_utterances(spark, sf):
    """Canonical utterances: every text trimmed, NULL as the empty text, cantons in capitals."""
    t = table(spark, sf, "merged_train")
    texts = [F.coalesce(C.strip(c), F.lit("")).alias(c) for c in ("sentence", "client_id")]
    u = conform(t.withColumn("path", F.col("utt_id")), "utterance")  # the id travels in the path
    return u.select(F.col("path").cast("long").alias("utt_id"), *texts, F.upper(F.coalesce(C.strip("canton"), F.lit(""))).alias("canton"), F.coalesce(C.strip("zipcode"), F.lit("")).alias("zipcode"), "label_id")


@query("""select column_name, nulls, blanks, nans from (
  select 'sentence' as column_name, count(*) filter (sentence is null) as nulls, count(*) filter (trim(sentence) = '') as blanks, count(*) filter (lower(trim(sentence)) = 'nan') as nans from merged_train
  union all select 'client_id', count(*) filter (client_id is null), count(*) filter (trim(client_id) = ''), count(*) filter (lower(trim(client_id)) = 'nan') from merged_train
  union all select 'dialect_region', count(*) filter (dialect_region is null), count(*) filter (trim(dialect_region) = ''), count(*) filter (lower(trim(dialect_region)) = 'nan') from merged_train
  union all select 'duration', count(*) filter (duration is null), 0, count(*) filter ((cast(duration as varchar) = 'nan')) from merged_train)""")
def null_profile(spark, sf):
    """NULL, blank and NaN counts per column in one pass."""
    return reports.null_profile(table(spark, sf, "merged_train"), ["sentence", "client_id", "dialect_region", "duration"])


@query("""select nulls, count(*) as n from (select cast(sentence is null as int) + cast(client_id is null as int) + cast(canton is null as int)
  + cast(dialect_region is null as int) + cast(age is null as int) + cast(gender is null as int) + cast(duration is null as int) as nulls from merged_train) group by 1""")
def nulls_per_row(spark, sf):
    """Rows by their number of NULLs."""
    return reports.nulls_per_row(table(spark, sf, "merged_train"), ["sentence", "client_id", "canton", "dialect_region", "age", "gender", "duration"])


_CANTON = "case " + " ".join(f"when upper(trim(canton)) = '{k}' then '{v}'" for k, v in C.CANTON_REGION.items()) + " end"


@query(f"""select upper(trim(canton)) as canton, {_CANTON} as region, count(*) as n from merged_train group by all""")
def canton_coverage(spark, sf):
    """Region that each canton is mapped to, NULL for cantons without one, with their rows."""
    t = table(spark, sf, "merged_train").select(F.upper(F.trim("canton")).alias("canton"))
    return t.withColumn("region", C.canton_region(F.col("canton"))).groupBy("canton", "region").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select *, regexp_replace(replace(replace(replace(lower(nfc_normalize(dialect_region)), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '[^a-zâ]', '', 'g') as x from merged_train),
 l as (select *, case when x in ('basel', 'bâle') then 0 when x in ('bern', 'berne') then 1 when x = 'innerschweiz' then 2 when x = 'ostschweiz' then 3
   when x in ('wallis', 'valais') then 4 when x in ('zuerich', 'zurich') then 5 when x in ('graubuenden', 'graubunden') then 6 when x = 'german' then 7 when x = 'vorarlberg' then 8 end as named from r)
select coalesce(label_id, named) as label_id, cast(coalesce(label_id, named) = 7 as int) as is_german, count(*) as n, count(*) filter (label_id is null) as from_name from l group by all""")
def label_encoding(spark, sf):
    """Labels from label_id or the region's name, with the binary label."""
    t = table(spark, sf, "merged_train").select("label_id", region_label(F.col("dialect_region")).alias("named"))
    label = F.coalesce("label_id", "named")
    return t.groupBy(label.alias("label_id"), (label == 7).cast("int").alias("is_german")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_id").isNull()).alias("from_name"))


@query("""select dataset, count(*) as n, count(*) filter (d > 0) as usable, round(sum(d), 3) as seconds from (
  select dataset, greatest(case when duration is null or (cast(duration as varchar) = 'nan') then 0 else duration end, 0) as d from merged_train) group by all""")
def coerced_durations(spark, sf):
    """Durations made usable: missing, NaN and negative ones count as 0."""
    t = table(spark, sf, "merged_train").select("dataset", C.seconds(F.col("duration")).alias("d"))
    return t.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("usable"), F.round(F.sum("d"), 3).alias("seconds"))


@query("""select dataset, regexp_extract(lower(replace(audio_path, '\\', '/')), '\\.([a-z0-9]{1,5})$', 1) as kind, count(*) as n, count(distinct regexp_extract(lower(replace(audio_path, '\\', '/')), '([^/]+?)(\\.[a-z0-9]{1,5})?$', 1)) as files,
  count(*) filter (audio_path like '/%') as absolute from merged_train where trim(audio_path) <> '' group by all""")
def path_parts(spark, sf):
    """File types and different files of the audio paths, and how many are absolute."""
    p = F.col("audio_path")
    kind = F.regexp_extract(F.lower(C.path_part(p, 1)), r"\.([a-z0-9]{1,5})$", 1)
    t = table(spark, sf, "merged_train").where(F.trim(p) != "").select("dataset", kind.alias("kind"), file_key(p).alias("file"), p.startswith("/").alias("a"))
    return t.groupBy("dataset", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"), F.count_if("a").alias("absolute"))


_FILE = """regexp_extract(lower(replace(trim(audio_path), '\\', '/')), '([^/]+?)(\\.[a-z0-9]{1,5})?$', 1)"""
_RANK = "case dataset when 'mundart-lesung' then 0 when 'talwoerter' then 1 else 2 end"


@query(f"""select utt_id, file, dataset from (select *, row_number() over (partition by file order by {_RANK}, utt_id) as r from (select utt_id, dataset, {_FILE} as file from merged_train where trim(audio_path) <> '')) where r = 1""")
def dedupe_first(spark, sf):
    """One utterance for each file: that of the preferred dataset, then the lowest id."""
    t = table(spark, sf, "merged_train").select("utt_id", file_key(F.col("audio_path")).alias("file"), "dataset").where("file is not null")
    rank = F.when(F.col("dataset") == "mundart-lesung", 0).when(F.col("dataset") == "talwoerter", 1).otherwise(2)
    return rows.first_row(t, ["file"], [rank, F.col("utt_id")])


@query("""select episode_id, podcast, episode, num_speakers, processed_at from (select *, row_number() over (partition by episode_id order by processed_at desc nulls first) as r from episodes) where r = 1""")
def dedupe_last(spark, sf):
    """The latest processing of each episode; one without a time wins."""
    t = table(spark, sf, "episodes").select("episode_id", "podcast", "episode", "num_speakers", "processed_at")
    return rows.last_row(t, ["episode_id"], [F.col("processed_at").isNull(), F.col("processed_at")])


_INFO = "cast(trim(coalesce(age, '')) <> '' as int) + cast(trim(coalesce(gender, '')) <> '' as int) + cast(trim(coalesce(canton, '')) <> '' as int) + cast(trim(coalesce(zipcode, '')) <> '' as int)"


@query(f"""select utt_id, {_INFO} as info, label_id from merged_train where label_id = 7 order by info desc, md5('42|' || utt_id), utt_id limit 100""")
def top_ranked(spark, sf):
    """The 100 German utterances with the most metadata, ties by a seeded shuffle."""
    t = table(spark, sf, "merged_train").where("label_id = 7").select("utt_id", C.completeness(*[F.col(c) for c in ("age", "gender", "canton", "zipcode")]).alias("info"), "label_id")
    return rows.top(t, 100, [F.col("info").desc()], "utt_id")


@query("""select utt_id, label_id from (select utt_id, label_id, row_number() over (partition by label_id order by md5('42|' || utt_id), utt_id) as r from merged_train where label_id is not null) where r <= 30""")
def sample_per_label(spark, sf):
    """30 utterances of each label by a seeded shuffle."""
    return rows.sample_per_group(table(spark, sf, "merged_train").select("utt_id", "label_id"), "label_id", "utt_id", 30)


@query("""select utt_id from merged_train order by md5('7|' || utt_id), utt_id limit 50""")
def reservoir_sample(spark, sf):
    """50 utterances by a seeded shuffle."""
    return rows.top(table(spark, sf, "merged_train").select("utt_id"), 50, [], "utt_id", seed=7)


@query(f"""select label_id, fold, count(*) as n, min(utt_id) as first_id from (select utt_id, label_id, cast((row_number() over (partition by label_id order by md5('13|' || utt_id), utt_id) - 1) % 5 as int) as fold from {_ALL} where label_id is not null) group by all""")
def stratified_folds(spark, sf):
    """Five folds with each label dealt evenly."""
    f = rows.folds(_all(spark, sf, "utt_id", "label_id").where("label_id is not null"), "label_id", "utt_id")
    return f.groupBy("label_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("utt_id").alias("first_id"))


@query("""select utt_id, row_number() over (order by md5('42|' || utt_id), utt_id) <= greatest(1, cast(floor(0.1 * (select count(*) from merged_train)) as bigint)) as is_eval from merged_train""")
def holdout_split(spark, sf):
    """A tenth of the utterances held out by a seeded shuffle."""
    return rows.holdout(table(spark, sf, "merged_train").select("utt_id"), "utt_id", 0.1)


_QUOTA_POOL = f"(select utt_id, {_INFO} as info from "


@query(f"""with t as (select * from {_QUOTA_POOL} merged_test where label_id = 7) order by info desc, md5('42|' || utt_id), utt_id limit 40),
v0 as (select * from {_QUOTA_POOL} merged_valid where label_id = 7) order by info desc, md5('42|' || utt_id), utt_id limit 200),
v1 as (select * from {_QUOTA_POOL} merged_test where label_id = 7 and utt_id not in (select utt_id from t)) order by info desc, md5('42|' || utt_id), utt_id limit greatest(0, 200 - (select count(*) from v0))),
tr as (select * from {_QUOTA_POOL} merged_train where label_id = 7) order by info desc, md5('42|' || utt_id), utt_id limit 300)
select *, 'test' as split from t union all select *, 'valid' from v0 union all select *, 'valid' from v1 union all select *, 'train' from tr""")
def quota_fill(spark, sf):
    """Test, validation and training quotas of German utterances, with test as the fallback of validation and no row
    used twice."""
    pool = lambda s: table(spark, sf, f"merged_{s}").where("label_id = 7").select("utt_id", C.completeness(*[F.col(c) for c in ("age", "gender", "canton", "zipcode")]).alias("info"))
    test = pool("test")
    return rows.fill_quotas([("test", test, None, 40), ("valid", pool("valid"), test, 200), ("train", pool("train"), None, 300)], "utt_id", [F.col("info").desc()])


@query("""with s as (select distinct trim(sentence) as s from merged_test where trim(sentence) <> ''), t as (select distinct trim(sentence) as s from merged_train where trim(sentence) <> ''), v as (select distinct trim(sentence) as s from merged_valid where trim(sentence) <> '')
select 'test and train' as what, count(*) as n from (select * from s intersect select * from t) union all select 'test not train', count(*) from (select * from s except select * from t)
union all select 'any', count(*) from (select * from s union select * from t union select * from v)""")
def sentence_sets(spark, sf):
    """Different sentences that test and training share, that only test has, and of all splits."""
    s, t, v = (table(spark, sf, f"merged_{x}").select(F.trim("sentence").alias("s")).where("s <> ''").distinct() for x in ("test", "train", "valid"))
    n = lambda what, d: d.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return n("test and train", s.intersect(t)).unionByName(n("test not train", s.subtract(t))).unionByName(n("any", s.union(t).union(v).distinct()))


@query("""with p as (select unnest([{'c': 'gender', 'v': gender}, {'c': 'age', 'v': age}, {'c': 'dataset', 'v': dataset}, {'c': 'canton', 'v': canton}]) as p from merged_train),
n as (select p.c as column_name, p.v as value, count(*) as n from p group by all) select column_name, value, n, round(100 * n / sum(n) over (partition by column_name), 1) as pct from n""")
def value_counts(spark, sf):
    """Counts and shares of the values of four columns in one pass."""
    return reports.value_counts(table(spark, sf, "merged_train"), ["gender", "age", "dataset", "canton"])


_SEC = "greatest(case when duration is null or (cast(duration as varchar) = 'nan') then 0 else duration end, 0)"


@query(f"""select dialect_region, case when dialect_region is null then 0 else round(sum({_SEC}) / 3600, 4) end as hours from merged_train group by dialect_region""")
def hours_by_region(spark, sf):
    """Hours per delivered region; rows without one have none."""
    t = table(spark, sf, "merged_train").groupBy("dialect_region").agg((F.sum(C.seconds(F.col("duration"))) / 3600).alias("h"))
    return t.select("dialect_region", F.when(F.col("dialect_region").isNull(), 0.0).otherwise(F.round("h", 4)).alias("hours"))


@query("""select dataset, count(*) as n, round(100 * count(*) filter (duration > 0 and not (cast(duration as varchar) = 'nan')) / count(*), 1) as usable_pct, round(avg(d), 6) as mean, median(d) as median, min(d) as least, max(d) as most
  from (select *, case when duration > 0 and not (cast(duration as varchar) = 'nan') then duration end as d from merged_train) group by all""")
def describe_durations(spark, sf):
    """Mean, median and range of usable durations, and their share."""
    d = F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.col("duration"))
    t = table(spark, sf, "merged_train").select("dataset", d.alias("d"))
    return t.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.count("d") / F.count(F.lit(1)), 1).alias("usable_pct"), F.round(F.avg("d"), 6).alias("mean"), F.median("d").alias("median"), F.min("d").alias("least"), F.max("d").alias("most")
    )


@query(f"""select label_id, count(*) filter (split = 'train') as train, count(*) filter (split = 'valid') as valid, count(*) filter (split = 'test') as test from {_ALL} group by all""")
def region_by_split(spark, sf):
    """Crosstab of labels and splits."""
    return _all(spark, sf, "label_id").groupBy("label_id").pivot("split", ["train", "valid", "test"]).agg(F.count(F.lit(1))).na.fill(0, ["train", "valid", "test"])


@query("""select *, largest / smallest as ratio, case when largest / smallest > 5 then 'severe' when largest / smallest > 2 then 'moderate' else 'balanced' end as severity from (
  select count(*) as classes, max(n) as largest, min(n) as smallest from (select label_id, count(*) as n from merged_train where label_id is not null group by all))""")
def class_balance(spark, sf):
    """Ratio of the largest and the smallest class, with its severity."""
    return reports.class_balance(table(spark, sf, "merged_train"), "label_id")


@query("""with n as (select label_id, count(*) as n from merged_train where label_id is not null group by all), w as (select *, 1 / greatest(n / sum(n) over (), 1e-6) as w from n)
select label_id, n, round(w / avg(w) over (), 6) as weight from w""")
def class_weights(spark, sf):
    """Inverse-frequency weights with mean 1."""
    return reports.class_weights(table(spark, sf, "merged_train"), "label_id").withColumn("weight", F.round("weight", 6))


_LABELS = ", ".join(f"({i}, '{n}')" for i, n in REGIONS.items())


def _dist_sql(grain: str, on: str) -> str:
    g = f"{grain}, " if grain else ""
    return f"""with h as (select {g}label_id, count(*) as clips, sum({_SEC}) / 3600 as hours, count(distinct client_id) as speakers from merged_train where label_id is not null group by all),
l(label_id, label_name) as (values {_LABELS}), g as (select distinct {grain or "1 as one"} from h),
j as (select {"g." + grain + "," if grain else ""} l.label_id, l.label_name, coalesce(clips, 0) as clips, coalesce(hours, 0) as hours, coalesce(speakers, 0) as speakers from g cross join l left join h on h.label_id = l.label_id {on})
select {g}label_id, label_name, clips, coalesce(round(100 * clips / nullif(sum(clips) over (partition by {grain or "1"}), 0), 2), 0) as clips_pct_all,
  case when label_id = 7 then 0 else coalesce(round(100 * clips / nullif(sum(case when label_id = 7 then 0 else clips end) over (partition by {grain or "1"}), 0), 2), 0) end as clips_pct_excl, round(hours, 4) as hours, speakers,
  coalesce(round(100 * speakers / nullif(sum(speakers) over (partition by {grain or "1"}), 0), 2), 0) as speakers_pct_all,
  case when label_id = 7 then 0 else coalesce(round(100 * speakers / nullif(sum(case when label_id = 7 then 0 else speakers end) over (partition by {grain or "1"}), 0), 2), 0) end as speakers_pct_excl from j"""


@query(_dist_sql("", ""))
def distribution_overall(spark, sf):
    """Clips, hours and speakers of every label, with shares of all and of all but German."""
    d = reports.distribution(table(spark, sf, "merged_train").select("label_id", "duration", "client_id"), [], "label_id", C.seconds(F.col("duration")) / 3600, "client_id", REGIONS, 7)
    return d.withColumn("hours", F.round("hours", 4))


@query(_dist_sql("dataset", "and h.dataset is not distinct from g.dataset"))
def distribution_by_dataset(spark, sf):
    """The same per dataset."""
    t = table(spark, sf, "merged_train").select("dataset", "label_id", "duration", "client_id")
    d = reports.distribution(t, ["dataset"], "label_id", C.seconds(F.col("duration")) / 3600, "client_id", REGIONS, 7)
    return d.withColumn("hours", F.round("hours", 4))


@query(f"""select grouping(dataset)::integer as all_datasets, grouping(gender)::integer as all_genders, dataset, gender, label_id, count(*) as clips, round(sum({_SEC}) / 3600, 4) as hours from merged_train
group by grouping sets ((label_id), (dataset, label_id), (dataset, gender, label_id))""")
def multi_grain(spark, sf):
    """Clips and hours per label at three grains in one pass."""
    t = table(spark, sf, "merged_train").select("dataset", "gender", "label_id", C.seconds(F.col("duration")).alias("d"))
    d, g, l = F.col("dataset"), F.col("gender"), F.col("label_id")
    s = t.groupingSets([[l], [d, l], [d, g, l]], d, g, l).agg(F.grouping("dataset").cast("int").alias("all_datasets"), F.grouping("gender").cast("int").alias("all_genders"), F.count(F.lit(1)).alias("clips"), F.round(F.sum("d") / 3600, 4).alias("hours"))
    return s.select("all_datasets", "all_genders", "dataset", "gender", "label_id", "clips", "hours")


@query("""select case when grouping(podcast) = 1 then 'all' else podcast end as podcast, count(*) as episodes, round(sum(greatest(coalesce(duration_sec, 0), 0)) / 3600, 4) as hours, sum(num_speakers)::bigint as speakers
from (select *, row_number() over (partition by episode_id order by processed_at desc nulls first) as r from episodes) where r = 1 group by rollup(podcast)""")
def show_rollup(spark, sf):
    """Episodes and hours per podcast and in total, each episode once."""
    t = rows.last_row(table(spark, sf, "episodes"), ["episode_id"], [F.col("processed_at").isNull(), F.col("processed_at")])
    return t.rollup("podcast").agg(F.grouping("podcast").alias("_g"), F.count(F.lit(1)).alias("episodes"), F.round(F.sum(C.seconds(F.col("duration_sec"))) / 3600, 4).alias("hours"), F.sum("num_speakers").alias("speakers")).select(
        F.when(F.col("_g") == 1, "all").otherwise(F.col("podcast")).alias("podcast"), "episodes", "hours", "speakers"
    )


@query(f"""with s as (select case when grouping(split) = 1 then 'all' else split end as split, count(*) as rows, count(distinct client_id) as speakers, round(sum({_SEC}) / 3600, 4) as hours from {_ALL} group by rollup(split))
select split, rows, round(100 * rows / max(rows) over (), 1) as pct, speakers, hours from s""")
def split_summary(spark, sf):
    """Rows, shares, speakers and hours of the splits and in total."""
    s = reports.split_summary(_all(spark, sf, "client_id", "duration"), "split", "client_id", C.seconds(F.col("duration")) / 3600)
    return s.withColumn("hours", F.round("hours", 4))


@query(f"""select array_to_string(s, ',') as splits, count(*) as speakers, sum(n)::bigint as rows from (select client_id, list_sort(list(distinct split)) as s, count(*) as n from {_ALL} where client_id is not null group by all) group by all""")
def speaker_disjointness(spark, sf):
    """Speakers by the splits in which their id occurs."""
    t = _all(spark, sf, "client_id").where("client_id is not null")
    s = t.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("splits").agg(F.count(F.lit(1)).alias("speakers"), F.sum("n").alias("rows"))


@query("""select audio_path, count(*) as n from merged_train group by all having count(*) > 1""")
def duplicate_paths(spark, sf):
    """Audio paths that occur more than once."""
    return reports.duplicate_keys(table(spark, sf, "merged_train"), "audio_path")


@query(f"""with a as (select distinct {_FILE} as file from merged_train where trim(audio_path) <> ''), b as (select distinct {_FILE} as file from train_phonemes where trim(audio_path) <> '')
select 'only_a' as side, count(*) as n from (select * from a except select * from b) union all select 'only_b', count(*) from (select * from b except select * from a)""")
def clip_diff(spark, sf):
    """Clips that only the utterances or only the phonemes have."""
    a, b = (table(spark, sf, t).select(file_key(F.col("audio_path")).alias("file")) for t in ("merged_train", "train_phonemes"))
    return reports.key_diff(a, b, "file").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


_NONE = "(phoneme is null or lower(trim(phoneme)) in ('', 'nan', 'null', 'none', 'no_phoneme', 'error'))"


@query(f"""with o as (select distinct {_FILE} as file from train_phonemes where trim(audio_path) <> ''), g as (select distinct {_FILE} as file from train_phonemes where trim(audio_path) <> '' and not {_NONE}),
u as (select {_FILE} as file from merged_train where trim(audio_path) <> '')
select case when file in (select file from g) then 'usable' when file in (select file from o) then 'without phonemes' else 'not transcribed' end as category, count(*) as n from u group by all""")
def phoneme_origin(spark, sf):
    """Where each utterance's phonemes stand: usable, delivered without any, or not there."""
    key = file_key(F.col("audio_path")).alias("file")
    p = table(spark, sf, "train_phonemes")
    u = table(spark, sf, "merged_train").select(key).where("file is not null")
    m = reports.membership(u, {"any": p.select(key), "good": p.where(~C.is_placeholder(F.col("phoneme"), C.PHONE_PLACEHOLDERS)).select(key)}, "file")
    category = F.when(F.col("in_good"), "usable").when(F.col("in_any"), "without phonemes").otherwise("not transcribed")
    return m.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with p as (select {_FILE} as file, min(case when not {_NONE} then trim(phoneme) end) as phoneme from train_phonemes where trim(audio_path) <> '' group by all)
select u.utt_id, coalesce(p.phoneme, '') as phoneme, {_SEC} as seconds from (select *, {_FILE} as file from {_ALL}) u left join p on p.file = u.file and u.file <> ''""")
def phonemes_joined(spark, sf):
    """Utterances with the phonemes of their clip, one row each however often a clip was transcribed."""
    key = file_key(F.col("audio_path")).alias("file")
    good = F.when(~C.is_placeholder(F.col("phoneme"), C.PHONE_PLACEHOLDERS), F.trim("phoneme"))
    p = table(spark, sf, "train_phonemes").select(key, good.alias("phoneme")).where("file is not null").groupBy("file").agg(F.min("phoneme").alias("phoneme"))
    u = _all(spark, sf, "utt_id", "audio_path", "duration").select("utt_id", key, C.seconds(F.col("duration")).alias("seconds"))
    return u.join(p, "file", "left").select("utt_id", F.coalesce("phoneme", F.lit("")).alias("phoneme"), "seconds")


@query(f"""select count(*) as joined, count(distinct utt_id) as utterances from (select u.utt_id from (select utt_id, {_FILE} as file from merged_train where trim(audio_path) <> '') u left join (select {_FILE} as file from train_phonemes where trim(audio_path) <> '') p using (file))""")
def fan_out(spark, sf):
    """How the rows of the utterances multiply when joined with every transcription of their clip."""
    key = file_key(F.col("audio_path")).alias("file")
    u = table(spark, sf, "merged_train").select("utt_id", key).where("file is not null")
    p = table(spark, sf, "train_phonemes").select(key).where("file is not null")
    return u.join(p, "file", "left").agg(F.count(F.lit(1)).alias("joined"), F.count_distinct("utt_id").alias("utterances"))


@query(f"""with t as (select {_FILE} as file from merged_train where trim(audio_path) <> '')
select utt_id from (select utt_id, {_FILE} as file from merged_test where trim(audio_path) <> '') where file not in (select file from t)""")
def unseen_files(spark, sf):
    """Test utterances whose file training does not have (anti join)."""
    key = file_key(F.col("audio_path")).alias("file")
    test = table(spark, sf, "merged_test").select("utt_id", key).where("file is not null")
    return rows.unless_done(test, table(spark, sf, "merged_train").select(key).where("file is not null"), "file").select("utt_id")


@query("""select count(*) as rows, count(*) filter (trim(sentence) <> '') as filled, count(distinct client_id) as speakers from merged_train where label_id is not null""")
def label_coverage(spark, sf):
    """Labelled rows, those with a sentence, and speakers."""
    t = table(spark, sf, "merged_train").where("label_id is not null")
    return t.agg(F.count(F.lit(1)).alias("rows"), F.count_if(C.non_empty(F.col("sentence"))).alias("filled"), F.count_distinct("client_id").alias("speakers"))


@query()
def table_fingerprint(spark, sf):
    """An order-free digest of the training split's path, sentence and label."""
    return reports.fingerprint(table(spark, sf, "merged_train"), ["audio_path", "sentence", "label_id"])


@query(r"""select utt_id, trim(regexp_replace(regexp_replace(lower(sentence), '[^\p{L}\p{M}\p{N}_\s\x{00A0}]', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g')) as words from """ + _ALL)
def normalised_words(spark, sf):
    """Sentences in lower case without punctuation."""
    return _all(spark, sf, "utt_id", "sentence").select("utt_id", words_only(F.col("sentence")).alias("words"))


def _synthesis_sql() -> str:
    t = r"trim(regexp_replace(upper(left(sentence, 1)) || substr(sentence, 2), '[\s\x{00A0}]+', ' ', 'g'), ' ')"
    for old, new in PUNCTUATION:
        t = "replace({}, '{}', '{}')".format(t, old, new.replace("'", "''"))
    return f"select utt_id, case when sentence = '' then '{NOTHING_TO_SAY}' when regexp_matches(t, '[.!?,-]$') then t else t || '.' end as text from (select utt_id, sentence, rtrim({t}, ' ') as t from {_ALL})"


@query(_synthesis_sql())
def synthesis_text(spark, sf):
    """Sentences prepared for synthesis."""
    return _all(spark, sf, "utt_id", "sentence").select("utt_id", for_synthesis(F.col("sentence")).alias("text"))


@query("""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as net from lineitem group by all""")
def line_summary(spark, sf):
    """Grouped sums over the largest table, as a bench of plain scans and aggregation."""
    t = table(spark, sf, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"))


@query("""select r_name, n_name, count(distinct o_orderkey) as orders, round(sum(l_extendedprice * (1 - l_discount)), 2) as net from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by grouping sets ((r_name, n_name), (r_name))""")
def star_join(spark, sf):
    """Five-way star join with two grains."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("o_orderkey = l_orderkey")).join(table(spark, sf, "customer"), F.expr("c_custkey = o_custkey"))
    j = j.join(table(spark, sf, "nation"), F.expr("n_nationkey = c_nationkey")).join(table(spark, sf, "region"), F.expr("r_regionkey = n_regionkey"))
    r, n = F.col("r_name"), F.col("n_name")
    return j.groupingSets([[r, n], [r]], r, n).agg(F.count_distinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"))
