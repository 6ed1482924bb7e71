"""Queries over transcripts, phonemes, predictions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import file_key, speaker_key
from mundspark.functions.regions import REGIONS
from mundspark.operators import errors, features, intervals, metrics, transcript
from mundspark.operators.intervals import to_ms
from mundspark.operators.matching import contains_join
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


_NUM = "case when cast({0} as varchar) = 'nan' then null else {0} end"
_MUSIC = "lower(rtrim(ltrim(regexp_replace(rtrim(coalesce({0}, ''), {1}), '[.]$', ''), {1} || '[(-–—'), {1} || '])-–—')) = 'musik'".format("text", "' ' || chr(9) || chr(10) || chr(13) || chr(160)")
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
_ENDS = "right(rtrim(regexp_replace(rtrim({0}, _B), '[»\"'']$', ''), _B), 1) in ('.', '!', '?')".replace("_B", _BLANK)
_SEG = f"""s as (select episode_id, segment_id, {_NUM.format('start')} as st, {_NUM.format('"end"')} as en, coalesce(speaker, '') as speaker, coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '') as text,
  coalesce({_NUM.format('overlap_coverage')}, 0) as ov from transcript_segments)"""


@query(f"""with {_SEG}, p as (select *, lag(speaker) over w as ps, lag(en) over w as pe, lag(text) over w as pt from s window w as (partition by episode_id order by st nulls first, en nulls first, segment_id)),
f as (select *, case when ps = speaker and st - pe <= 0.8 and not coalesce({_ENDS.format('pt')}, false) then 0 else 1 end as new from p),
i as (select *, sum(new) over (partition by episode_id order by st nulls first, en nulls first, segment_id) as island from f)
select episode_id, round(arg_min(st, o), 3) as start, round(arg_max_null(en, o), 3) as "end", arg_min(speaker, o) as speaker, coalesce(string_agg(text, ' ' order by o) filter (text <> ''), '') as text,
  coalesce(round(sum(greatest(coalesce(en - st, 0), 0) * ov) / nullif(sum(greatest(coalesce(en - st, 0), 0)), 0), 3), 0) as overlap_coverage, count(*) as segments
from (select *, row_number() over (partition by episode_id order by st nulls first, en nulls first, segment_id) as o from i) group by episode_id, island""")
def sentences(spark, sf):
    """Segments joined to sentences: same speaker, pause of at most 0.8 s, sentence not ended."""
    return transcript.sentences(table(spark, sf, "transcript_segments"), "episode_id", "segment_id")


@query(rf"""with s as (select episode_id, segment_id, start, coalesce(text, '') as text from transcript_segments
  where upper(trim(coalesce(speaker, ''))) <> 'UNKNOWN' and not {_MUSIC}),
q as (select *, trim(trim(translate(trim(regexp_replace(nfc_normalize(replace(text, '…', '...')), '[\s\x{{00A0}}]+', ' ', 'g'), ' '), '„“«»‚’', repeat(chr(34), 4) || chr(39) || chr(39)), chr(34) || chr(39)), '[]()') as t from s),
n as (select *, lower(regexp_replace(t, '[.!?\s]+$', '')) as k from q),
f as (select *, case when k = lag(k) over (partition by episode_id order by start, segment_id) then 0 else 1 end as new from n),
i as (select *, sum(new) over (partition by episode_id order by start, segment_id) as island from f)
select episode_id, segment_id from i qualify not (k <> '' and count(*) over (partition by episode_id, island) >= 3)""")
def runs_dropped(spark, sf):
    """Segments left when music, unknown speakers and runs of three equal texts are gone."""
    s = table(spark, sf, "transcript_segments").select("episode_id", "segment_id", "start", "speaker", "text")
    return transcript.drop_runs(transcript.speech_only(s), "episode_id", ["start", "segment_id"]).select("episode_id", "segment_id")


@query(f"""select {_MUSIC} as music, upper(trim(coalesce(speaker, ''))) = 'UNKNOWN' as unknown, {_ENDS.format('text')} as ends, count(*) as n
from (select segment_id, speaker, coalesce(text, '') as text from transcript_segments) group by all""")
def segment_kinds(spark, sf):
    """Segments by what the transcript filters tell of them."""
    s = table(spark, sf, "transcript_segments").select("speaker", F.coalesce("text", F.lit("")).alias("text"))
    return s.groupBy(C.is_music(F.col("text")).alias("music"), C.is_unknown_speaker(F.col("speaker")).alias("unknown"), C.ends_sentence(F.col("text")).alias("ends")).agg(F.count(F.lit(1)).alias("n"))


@query()
def sentence_parts(spark, sf):
    """Segments of several sentences cut at their ends, the time shared out by characters."""
    s = table(spark, sf, "transcript_segments").where("text is not null")
    return transcript.split_sentences(s, ["episode_id", "segment_id"], "text", "start", "end").where("start is not null and not isnan(end)")


_MS = """i as (select episode_id, segment_id, cast(round(start * 1000) as bigint) as s, cast(round("end" * 1000) as bigint) as e, nullif(regexp_extract(speaker, '([0-9]+)', 1), '') as label
  from transcript_segments where start is not null and cast(start as varchar) <> 'nan' and "end" is not null and cast("end" as varchar) <> 'nan')"""


def _intervals(spark, sf) -> DataFrame:
    s = table(spark, sf, "transcript_segments").select("episode_id", "segment_id", to_ms(F.col("start")).alias("s"), to_ms(F.col("end")).alias("e"), F.nullif(F.regexp_extract("speaker", "([0-9]+)", 1), F.lit("")).alias("label"))
    return s.where("s is not null and e is not null")


@query(f"""with {_MS}, a as (select * from i where label is null), b as (select * from i where label is not null),
o as (select a.segment_id, b.label, sum(least(a.e, b.e) - greatest(a.s, b.s)) as n from a join b on a.episode_id = b.episode_id and a.s < b.e and b.s < a.e and a.e > a.s and b.e > b.s group by all),
r as (select *, row_number() over (partition by segment_id order by n desc, label) as r from o)
select a.segment_id, coalesce(r.label, 'UNKNOWN') as label from a left join r on r.segment_id = a.segment_id and r.r = 1""")
def overlap_attribution(spark, sf):
    """Speaker of each unlabelled segment by the largest overlap with labelled ones."""
    i = _intervals(spark, sf)
    turns = i.where("label is not null").select("episode_id", F.col("s").alias("ts"), F.col("e").alias("te"), "label")
    return intervals.attribute(i.where("label is null"), turns, "episode_id", "segment_id", ("s", "e"), ("ts", "te"), "label")


@query(f"""with {_MS}, v as (select * from i where e > s), t as (select segment_id, episode_id, unnest(range(s, e, 200)) as at from v),
c as (select t.segment_id, t.at, count(*) as n from t join v b on b.episode_id = t.episode_id and b.s <= t.at and t.at < b.e group by all)
select segment_id, count(*) as samples, count(*) filter (n >= 2) / count(*) as share from c group by all""")
def overlap_share(spark, sf):
    """Share of each segment's instants, 200 ms apart, at which two or more segments are running."""
    i = _intervals(spark, sf)
    turns = i.select("episode_id", F.col("s").alias("ts"), F.col("e").alias("te"))
    return intervals.multiplicity(i, turns, "episode_id", "segment_id", ("s", "e"), ("ts", "te"), 200)


@query("""with a as (select distinct path as a_path from merged_test where path <> ''), b as (select utt_id as b_id, audio_path as b_path from merged_train where audio_path <> '' )
select a_path, min(b_id) as b_id from a left join b on contains(b_path, a_path) or contains(a_path, b_path) group by all""")
def substring_match(spark, sf):
    """First training utterance whose audio path contains a test path or is contained in it."""
    a = table(spark, sf, "merged_test").where("path <> ''").select(F.col("path").alias("a_path")).distinct()
    b = table(spark, sf, "merged_train").where("audio_path <> ''").select(F.col("utt_id").alias("b_id"), F.col("audio_path").alias("b_path"))
    return contains_join(a, b, "a_path", "b_path", "b_id").select("a_path", "b_id")


def _clips(spark, sf) -> DataFrame:
    p = table(spark, sf, "train_phonemes").select(file_key(F.col("audio_path")).alias("doc"), "label_id", "phoneme").where("doc is not null")
    good = ~C.is_placeholder(F.col("phoneme"), C.PHONE_PLACEHOLDERS)
    return p.where(good).groupBy("doc").agg(F.min("label_id").alias("label"), F.min("phoneme").alias("phoneme"))


_CLIPS = """p as (select regexp_extract(lower(replace(trim(audio_path), '\\', '/')), '([^/]+?)(\\.[a-z0-9]{1,5})?$', 1) as doc, min(label_id) as label, min(phoneme) as phoneme from train_phonemes
  where trim(audio_path) <> '' and not (phoneme is null or lower(trim(phoneme)) in ('', 'nan', 'null', 'none', 'no_phoneme', 'error')) group by 1),
t as (select doc, label, list_filter(string_split(lower(phoneme), ' '), lambda x: x not in ('', 'no_phoneme', 'error', 'nan')) as t from p)"""


def _gram_sql(sizes: tuple[int, ...]) -> str:
    return " union all ".join(f"select doc, array_to_string(t[i:i + {n - 1}], ' ') as term from (select doc, t, unnest(range(1, len(t) - {n - 2})) as i from t where len(t) >= {n})" for n in sizes)


_DROP = ("no_phoneme", "error", "nan")


@query(f"""with {_CLIPS}, g as ({_gram_sql((2, 3, 4))}), c as (select doc, term, count(*) as tf from g group by all)
select term, count(*) as df, sum(tf)::bigint as cf from c group by all having count(*) >= 2""")
def ngram_vocabulary(spark, sf):
    """2- to 4-grams of phonemes that occur in at least two clips."""
    return features.vocabulary(features.term_counts(_clips(spark, sf), "doc", F.col("phoneme"), drop=_DROP))


@query(f"""with {_CLIPS}, g as ({_gram_sql(features.SIZES)}), c as (select doc, term, count(*) as tf from g group by all), v as (select term, count(*) as df from c group by all having count(*) >= 2), n as (select count(*) as n from p),
w as (select doc, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) as w from c join v using (term) cross join n),
u as (select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as w from w)
select doc, count(*) as terms, round(max(w), 6) as largest, round(sum(w), 5) as total from u group by all""")
def tfidf_rows(spark, sf):
    """TF-IDF rows of the clips' 2- to 4-grams, summed up per clip."""
    clips, arrays = _arrays(spark, sf)
    w = _weights(arrays, clips.count()).select("doc", F.transform("terms", lambda t: t["weight"]).alias("w"))
    return w.select("doc", F.size("w").cast("long").alias("terms"), F.round(F.array_max("w"), 6).alias("largest"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def _arrays(spark, sf, labelled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The clips, and their n-grams."""
    clips = _clips(spark, sf)
    clips = staged(clips.where("label is not null") if labelled else clips, "clips")
    return clips, staged(features.term_arrays(clips, "doc", F.col("phoneme"), ("label",), drop=_DROP), "terms")


def _weights(arrays: DataFrame, docs: int) -> DataFrame:
    rows = features.in_rows(arrays, "doc")
    return features.tfidf(rows, staged(features.vocabulary(rows), "vocabulary"), docs)


_HELD = "left(md5('5|' || doc), 1) in ('0', '1', '2')"


def _held(doc="doc"):
    return F.left(F.md5(F.concat(F.lit("5|"), F.col(doc))), F.lit(1)).isin("0", "1", "2")


def _bayes_sql(label: str, sizes: tuple[int, ...]) -> str:
    return f"""{_CLIPS}, g as ({_gram_sql(sizes)}), c as (select doc, term, count(*) as tf from g group by all),
l as (select doc, {label} as label from p where label is not null and not {_HELD} and {label} is not null), lc as (select c.*, l.label from c join l using (doc)),
v as (select term from lc group by term having count(*) >= 2), vn as (select count(*) as vn from v),
tf as (select label, term, sum(tf) as n from lc join v using (term) group by all), tot as (select label, sum(n) as total from tf group by all),
pr as (select label, ln(count(*) / sum(count(*)) over ()) as prior from l group by label),
d as (select pr.label, prior, coalesce(total, 0) + 0.1 * vn as den from pr left join tot using (label) cross join vn),
h as (select doc from p where label is not null and {_HELD}), hk as (select c.* from c join h using (doc) join v using (term)),
s as (select h.doc, d.label, d.prior + coalesce(sum(hk.tf * ln((coalesce(tf.n, 0) + 0.1) / d.den)), 0) as score from h cross join d left join hk on hk.doc = h.doc left join tf on tf.label = d.label and tf.term = hk.term group by h.doc, d.label, d.prior)"""


@query(f"""with {_bayes_sql("label", features.SIZES)} select doc, label, round(1 / sum(exp(score - m)) over (partition by doc), 5) as confidence from (select *, max(score) over (partition by doc) as m from s)
qualify row_number() over (partition by doc order by score desc, label) = 1""")
def bayes_labels(spark, sf):
    """Labels of held-out clips by multinomial naive Bayes on phoneme 2- to 4-grams."""
    return _bayes(spark, sf)[1].withColumn("confidence", F.round("confidence", 5))


def _bayes(spark, sf) -> tuple[DataFrame, DataFrame]:
    clips, arrays = _arrays(spark, sf, True)
    docs = features.label_counts(clips.where(~_held()))
    counts = staged(features.class_counts(features.in_rows(arrays.where(~_held()), "label"), list(docs)), "class-counts")
    nb = features.NaiveBayes.of(counts, docs, {x: [x] for x in docs})
    held = arrays.where(_held())
    return clips, nb.predict(features.in_rows(held, "doc"), held.select("doc"))


_GROUP = "case when trim(client_id) = '' or lower(trim(client_id)) in ('nan', 'none', 'null', 'unknown', '?') then null else coalesce(nullif(regexp_extract(regexp_replace(lower(trim(client_id)), '^.*[/:_]|[^0-9a-f]', '', 'g'), '^[0-9a-f]{16}$'), ''), lower(trim(client_id))) end"
_OWNER = f"""o as (select doc, min(grp) as grp from (select regexp_extract(lower(replace(trim(audio_path), '\\', '/')), '([^/]+?)(\\.[a-z0-9]{{1,5}})?$', 1) as doc, {_GROUP} as grp from merged_train where trim(audio_path) <> '')
  where grp is not null and doc not in ('', 'nan', 'none', 'null') group by doc)"""


def _stage_sql(name: str, where: str, label: str, of: str) -> str:
    """The probabilities of one stage, for all clips of `of`."""
    return f"""{name}l as (select doc, {label} as label from p where label is not null and not {_HELD} and {where}), {name}c as (select c.*, l.label from c join {name}l l using (doc)),
{name}v as (select term from {name}c group by term having count(*) >= 2), {name}n as (select count(*) as vn from {name}v),
{name}t as (select label, term, sum(tf) as n from {name}c join {name}v using (term) group by all), {name}s as (select label, sum(n) as total from {name}t group by all),
{name}r as (select label, ln(count(*) / sum(count(*)) over ()) as prior from {name}l group by label),
{name}d as (select r.label, prior, coalesce(total, 0) + 0.1 * vn as den from {name}r r left join {name}s s on s.label = r.label cross join {name}n),
{name}k as (select c.* from c join {of} using (doc) join {name}v using (term)),
{name}g as (select h.doc, d.label, d.prior + coalesce(sum(k.tf * ln((coalesce(t.n, 0) + 0.1) / d.den)), 0) as score from {of} h cross join {name}d d left join {name}k k on k.doc = h.doc left join {name}t t on t.label = d.label and t.term = k.term group by h.doc, d.label, d.prior),
{name}p as (select doc, label, exp(score - m) / sum(exp(score - m)) over (partition by doc) as p from (select *, max(score) over (partition by doc) as m from {name}g))"""


@query(f"""with {_CLIPS}, g as ({_gram_sql(features.SIZES)}), c as (select doc, term, count(*) as tf from g group by all), {_OWNER}, h as (select doc from p join o using (doc) where label is not null),
{_stage_sql("b", "true", "(label = 7)::int", "h")}, {_stage_sql("f", "label < 7", "label", "h")},
b1 as (select grp, avg(p) as pg from bp join o using (doc) where label = 1 group by grp), f1 as (select grp, label, avg(p) as p from fp join o using (doc) group by all),
f2 as (select * from f1 qualify row_number() over (partition by grp order by round(p, 12) desc, label) = 1), a as (select distinct grp from o)
select a.grp as "group", (coalesce(pg, 1) > 0.5)::int as is_german, round(coalesce(pg, 1), 5) as prob_german, case when coalesce(pg, 1) > 0.5 then 7 else f2.label end as label_id, round(case when coalesce(pg, 1) > 0.5 then coalesce(pg, 1) else f2.p end, 5) as confidence
from a left join b1 using (grp) left join f2 using (grp)""")
def two_stage_labels(spark, sf):
    """Speakers labelled in two stages from the mean probabilities of their clips: German or not, then the region. Both
    stages are fitted from one count of terms by label, and score a clip in one pass."""
    clips, arrays = _arrays(spark, sf, True)
    docs = features.label_counts(clips.where(~_held()))
    counts = staged(features.class_counts(features.in_rows(arrays.where(~_held()), "label"), list(docs)), "class-counts")
    binary = features.NaiveBayes.of(counts, docs, {0: [x for x in docs if x != 7], 1: [x for x in docs if x == 7]})
    fine = features.NaiveBayes.of(counts, docs, {x: [x] for x in docs if x < 7})
    owner = staged(_owners(spark, sf), "owners")
    mine = arrays.join(owner.select("doc"), "doc", "left_semi")
    s = staged(features.scores([binary, fine], features.in_rows(mine, "doc"), mine.select("doc")), "scores")
    mean = lambda k, m: features.mean_probabilities(features.probabilities(s, k, m.labels), owner)
    out = features.two_stage(owner.select("group"), mean(0, binary), mean(1, fine))
    return out.withColumn("prob_german", F.round("prob_german", 5)).withColumn("confidence", F.round("confidence", 5))


def _owners(spark, sf) -> DataFrame:
    """(doc, group): the speaker of each clip of merged_train."""
    t = table(spark, sf, "merged_train").select(file_key(F.col("audio_path")).alias("doc"), speaker_key(F.col("client_id")).alias("group"))
    return t.where("doc is not null and group is not null").groupBy("doc").agg(F.min("group").alias("group"))


@query()
def linear_labels(spark, sf):
    """Accuracy of a balanced logistic regression on hashed TF-IDF rows of held-out clips."""
    # numbers stand for the names of clips where terms are shuffled
    clips = staged(_clips(spark, sf).where("label is not null").select(F.monotonically_increasing_id().alias("doc"), "label", "phoneme", _held().alias("held")), "clips")
    terms = features.in_rows(staged(features.term_arrays(clips, "doc", F.col("phoneme"), lower=False, drop=_DROP), "terms"), "doc")
    vocabulary = staged(features.vocabulary(terms), "vocabulary")
    rows = staged(features.hashed_rows(terms, vocabulary, clips.count(), clips.select("doc", "label", "held")), "rows")
    model = features.linear_model(rows.where("not held"), features.label_counts(clips.where("not held")))
    return metrics.summary(metrics.confusion(model.predict(rows.where("held")), "label", "prediction"))


def _canton_label():
    region = C.canton_region(F.col("canton"))
    return C.lookup(region, {n: i for i, n in REGIONS.items()})


def _cm(spark, sf) -> DataFrame:
    t = table(spark, sf, "merged_train").select("label_id", F.coalesce(_canton_label(), F.lit(7)).alias("pred"))
    return metrics.confusion(t, "label_id", "pred")


_CANTON = "case " + " ".join(f"when upper(trim(canton)) = '{k}' then {next(i for i, n in REGIONS.items() if n == v)}" for k, v in C.CANTON_REGION.items()) + " end"
_CM = f"""cm as (select label_id as "true", pred, count(*) as n from (select label_id, coalesce({_CANTON}, 7) as pred from merged_train) where label_id is not null and pred is not null group by all)"""


@query(f"""with {_CM} select "true", pred, n, n / sum(n) over (partition by "true") as share from cm""")
def confusion_matrix(spark, sf):
    """Label against the region of the canton (German without one), with shares of the true class."""
    return metrics.normalised(_cm(spark, sf))


_PRF = f"""{_CM}, l as (select "true" as label from cm union select pred from cm),
c as (select label, coalesce((select sum(n) from cm where "true" = label and pred = label), 0) as hits, coalesce((select sum(n) from cm where "true" = label), 0)::bigint as support, coalesce((select sum(n) from cm where pred = label), 0) as predicted from l),
r as (select label, coalesce(hits / nullif(predicted, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall, support from c),
f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r)"""


@query(f"with {_PRF} select * from f")
def per_class_scores(spark, sf):
    """Precision, recall and F1 of every class."""
    return metrics.per_class(_cm(spark, sf))


@query(f"""with {_PRF} select sum(support)::bigint as n, round(sum(recall * support) / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(avg(recall), 6) as balanced_accuracy from f""")
def score_summary(spark, sf):
    """Accuracy, macro F1 and balanced accuracy."""
    s = metrics.summary(_cm(spark, sf))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")])


_EDGES = ", ".join(f"({a}, {b})" for a, bs in metrics.NEIGHBOURS.items() for b in bs)


@query(f"""with {_bayes_sql("label", features.SIZES)}, b as (select doc, label from s qualify row_number() over (partition by doc order by score desc, label) = 1),
cm as (select p.label as "true", b.label as pred, count(*) as n from b join p using (doc) group by all), e(a, b) as (values {_EDGES}),
k as (select "true" as label, sum(n)::bigint as support, coalesce(sum(n) filter ("true" = pred), 0)::bigint as correct, coalesce(sum(n) filter ("true" <> pred and exists (select 1 from e where a = "true" and b = pred)), 0)::bigint as neighbour from cm where "true" < 7 group by all),
o as (select *, support - correct - neighbour as other, (select count(*) from e where a = label) / 6 as chance from k)
select label, support, correct, neighbour, other, coalesce(neighbour / nullif(neighbour + other, 0), 0) as neighbour_share, chance, coalesce(neighbour / nullif(neighbour + other, 0), 0) / chance as lift from o""")
def neighbour_errors(spark, sf):
    """Errors of naive Bayes with neighbouring regions and others, and their lift."""
    clips, found = _bayes(spark, sf)
    return metrics.neighbour_table(metrics.confusion(found.join(clips.select("doc", F.col("label").alias("true")), "doc"), "true", "label"))


@query(f"""with v as (select {_CANTON} as vote, trim(client_id) as client_id, utt_id from merged_train where trim(client_id) <> ''), c as (select client_id, vote, count(*) as n, min(utt_id) as o from v where vote is not null group by all)
select client_id, vote, n from c qualify row_number() over (partition by client_id order by n desc, o) = 1""")
def speaker_vote(spark, sf):
    """Region of each speaker by majority, the one seen first on a tie."""
    t = table(spark, sf, "merged_train").select(F.trim("client_id").alias("client_id"), "utt_id", _canton_label().alias("vote")).where("client_id <> ''")
    return metrics.majority(t, "client_id", "vote", "utt_id")


@query("""select dataset, mode(gender order by gender) as gender, count(*) as n, round(coalesce(stddev_samp(d), 0), 6) as std_sample, round(stddev_pop(d), 6) as std_population, median(d) as median, max(d) as most from (
  select dataset, gender, case when duration > 0 and cast(duration as varchar) <> 'nan' then duration end as d from merged_train) group by all""")
def group_statistics(spark, sf):
    """Mode, both standard deviations, median and maximum per dataset."""
    d = F.when((F.col("duration") > 0) & ~F.isnan("duration"), F.col("duration"))
    t = table(spark, sf, "merged_train").select("dataset", "gender", d.alias("d"))
    return t.groupBy("dataset").agg(
        F.mode("gender", True).alias("gender"), F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.stddev_samp("d"), F.lit(0.0)), 6).alias("std_sample"), F.round(F.stddev_pop("d"), 6).alias("std_population"), F.median("d").alias("median"), F.max("d").alias("most")
    )


@query("""select podcast, episode_id, language_probability from (select *, row_number() over (partition by podcast order by language_probability desc nulls last, episode_id, processed_at) as r from episodes) where r = 1""")
def best_episodes(spark, sf):
    """The episode with the surest language of each podcast, the first on a tie."""
    e = table(spark, sf, "episodes").withColumn("_o", F.struct("episode_id", "processed_at"))
    return metrics.best_per(e, "podcast", "language_probability", "_o", ["episode_id", "language_probability"])


def _pairs(spark, sf) -> DataFrame:
    cols = lambda t, p: table(spark, sf, t).select(file_key(F.col("audio_path")).alias("file"), "dataset", F.col("utt_id").alias(f"{p}_id"), F.col("sentence").alias(p)).where(F.col("file").isNotNull() & F.col(p).isNotNull())
    return cols("merged_train", "reference").join(cols("merged_test", "hypothesis"), ["file", "dataset"])


_FILE = """regexp_extract(lower(replace(trim(audio_path), '\\', '/')), '([^/]+?)(\\.[a-z0-9]{1,5})?$', 1)"""
_WORDS = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s\x{{00A0}}\x{{0308}}]', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"
_RATES = f"""a as (select {_FILE} as file, dataset, utt_id as reference_id, sentence as reference from merged_train where trim(audio_path) <> '' and sentence is not null),
b as (select {_FILE} as file, dataset, utt_id as hypothesis_id, sentence as hypothesis from merged_test where trim(audio_path) <> '' and sentence is not null),
p as (select reference_id, hypothesis_id, {_WORDS.format('reference')} as r, {_WORDS.format('hypothesis')} as h, hypothesis from a join b using (file, dataset)),
w as (select *, list_filter(string_split(r, ' '), lambda x: x <> '') as rw, list_filter(string_split(h, ' '), lambda x: x <> '') as hw, replace(r, ' ', '') as rc, replace(h, ' ', '') as hc from p),
x as (select *, list_distinct(list_concat(rw, hw)) as vocab, list_distinct(list_concat(string_split(rc, ''), string_split(hc, ''))) as letters from w),
e as (select *, levenshtein(array_to_string(list_transform(rw, lambda t: chr(33 + list_position(vocab, t)::int)), ''), array_to_string(list_transform(hw, lambda t: chr(33 + list_position(vocab, t)::int)), '')) as word_edits,
  levenshtein(array_to_string(list_transform(string_split(rc, ''), lambda t: chr(33 + list_position(letters, t)::int)), ''), array_to_string(list_transform(string_split(hc, ''), lambda t: chr(33 + list_position(letters, t)::int)), '')) as char_edits from x),
r as (select reference_id, hypothesis_id, word_edits::integer as word_edits, len(rw)::integer as ref_words, char_edits::integer as char_edits, length(rc)::integer as ref_chars,
  case when len(rw) = 0 then case when h = '' then 0 else 1 end else word_edits / len(rw) end as wer, case when rc = '' then case when hypothesis = '' then 0 else 1 end else char_edits / length(rc) end as cer from e)"""


@query(f"with {_RATES} select * from r")
def error_rates(spark, sf):
    """Word and character error rates of the test sentence against the training sentence of the same file."""
    r = errors.error_rates(_pairs(spark, sf), "reference", "hypothesis")
    return r.select("reference_id", "hypothesis_id", "word_edits", "ref_words", "char_edits", "ref_chars", "wer", "cer")


@query()
def corpus_scores(spark, sf):
    """Corpus error rates, BLEU, chrF and TER per dataset and of all pairs."""
    p = _pairs(spark, sf)
    p = staged(p.unionByName(p.withColumn("dataset", F.lit("all"))), "pairs")
    out = errors.corpus_rates(errors.error_rates(p, "reference", "hypothesis"), "dataset")
    for score in (errors.bleu, errors.chrf, errors.translation_edit_rate):
        out = out.join(score(p, "reference", "hypothesis", "dataset"), "dataset", "left")
    return out


@query("""with c as (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings), m as (select label, i, avg(x) as m from c group by all), cen as (select label, list(m order by i) as cen from m group by all)
select vec_id, e.label, round(list_cosine_similarity(embedding::double[], cen), 6) as cosine from embeddings e join cen on cen.label = e.label""")
def centroid_cosine(spark, sf):
    """Cosine of each embedding to the centroid of its label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    x = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    return e.join(centre, "label").select("vec_id", "label", F.round(C.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine"))


@query("""select cast(i - 1 as int) as dim, count(*) as n, round(avg(x), 7) as mean, round(stddev_pop(x), 7) as std from (select unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by i""")
def dimension_statistics(spark, sf):
    """Mean and deviation of each dimension of the embeddings."""
    s = features.per_dimension(table(spark, sf, "embeddings"), "embedding")
    return s.select("dim", "n", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"))


@query("""select vec_id, round(list_avg(list_transform(embedding, lambda x: x::double)), 6) as mean, round(list_stddev_pop(list_transform(embedding, lambda x: x::double)), 6) as std, round(list_avg(list_transform(embedding, lambda x: abs(x::double))), 6) as magnitude from embeddings""")
def pooled_embeddings(spark, sf):
    """Mean, deviation and mean magnitude of each embedding."""
    p = table(spark, sf, "embeddings").select("vec_id", features.pooled(F.col("embedding")).alias("p"))
    return p.select("vec_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("mean", "std", "magnitude")])
