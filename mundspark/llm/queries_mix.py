"""Queries of problems 4, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mundspark.functions.keys import file_key, speaker_key
from mundspark.llm.languages import document_languages, label_faults, mixed_parts
from mundspark.llm.mixing import Mixer, mixer
from mundspark.llm.packing import containers, fill_report
from mundspark.operators.intervals import to_ms
from mundspark.runtime import staged, table

#: Milliseconds, and phoneme tokens, of a container.
SECONDS_MS, PHONES = 30_000, 512
#: Tokens of a phoneme row that are none (fixed values).
NO_PHONES = ("", "nan", "error", "NO_PHONEME")


def _speech(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "merged_train").select("utt_id", "client_id", "duration", "sentence")
    return containers(t, "utt_id", speaker_key(F.col("client_id")), to_ms(F.col("duration")), F.col("sentence"), SECONDS_MS)


def p4_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 30 s for the utterances of each speaker of merged_train."""
    return _speech(spark, sf)


def p4_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of p4_containers are."""
    return fill_report(_speech(spark, sf), SECONDS_MS)


def p4_phonemes(spark: SparkSession, sf: str) -> DataFrame:
    """Containers of 512 phoneme tokens for the rows of train_phonemes, by the speaker of the clip in merged_train."""
    clips = table(spark, sf, "merged_train").select(file_key(F.col("audio_path")).alias("file"), speaker_key(F.col("client_id")).alias("speaker")).where("file is not null and speaker is not null")
    owner = clips.groupBy("file").agg(F.min("speaker").alias("speaker"))
    rows = table(spark, sf, "train_phonemes").select("audio_path", "phoneme", file_key(F.col("audio_path")).alias("file"))
    # rows have no id of their own: a row is named by its clip, its text and its number among equal ones
    rows = rows.groupBy("audio_path", "file", "phoneme").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("no"))
    rows = rows.select("file", "phoneme", F.concat_ws("\u0001", F.coalesce("audio_path", F.lit("")), F.sha1(F.coalesce("phoneme", F.lit("\u0000"))), "no").alias("row_key"))
    phones = F.filter(F.split(F.trim("phoneme"), r"\s+"), lambda p: ~p.isin(*NO_PHONES))
    j = rows.join(owner, "file", "left").withColumn("n", F.when(F.col("phoneme").isNull(), 0).otherwise(F.size(phones)))
    return containers(j, "row_key", F.col("speaker"), F.col("n"), F.col("phoneme"), PHONES)


def _mixer(spark: SparkSession, sf: str) -> Mixer:
    return mixer(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that cannot reach their weight in a mix."""
    return _mixer(spark, sf).report().where("short").select("mix_name", "source")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each mix and how often each is used."""
    return _mixer(spark, sf).copies()


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and actual tokens and shares of each source of each mix."""
    return _mixer(spark, sf).report()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, and of documents in several languages."""
    return label_faults(table(spark, sf, "documents"))


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Every language of every document, with a confidence."""
    return document_languages(table(spark, sf, "documents"))


def p10_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of one language in documents written in several."""
    return mixed_parts(table(spark, sf, "documents"))


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of p4_containers: items, those placed, their length, items lost or longer or shorter than before, containers filled
    beyond their size, pieces of items that fit whole, and overlapping pieces."""
    t = table(spark, sf, "merged_train").select(F.col("utt_id").alias("id"), to_ms(F.col("duration")).alias("ms"))
    placed = staged(_speech(spark, sf), "placed")
    own = placed.groupBy(F.col("utt_id").alias("id")).agg(F.sum("length").alias("length"), F.count("container").alias("pieces"))
    j = t.join(own, "id", "left")
    usable, whole = F.col("ms") >= 1, F.col("ms") <= SECONDS_MS
    items = j.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(usable).alias("placed"), F.sum(F.when(usable, F.col("ms"))).alias("length"), F.count_if(usable & (F.coalesce("length", F.lit(0)) != F.col("ms"))).alias("changed"),
        F.count_if(~F.coalesce(usable, F.lit(False)) & (F.coalesce("pieces", F.lit(0)) > 0)).alias("unusable_placed"), F.count_if(usable & whole & (F.col("pieces") != 1)).alias("cut"),
    )
    boxes = placed.where("container is not null").groupBy("container").agg(F.sum("length").alias("used"), F.max(F.col("at") + F.col("length")).alias("end"))
    full = boxes.agg(F.count_if((F.col("used") > SECONDS_MS) | (F.col("end") != F.col("used"))).alias("overfull"))
    both = items.unionByName(full, allowMissingColumns=True)  # one row each
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Of p9_mix, for each mix: listed sources, documents used too often or of no listed source, and sources off their
    tokens by more than a document, but for those that cannot reach them."""
    m = _mixer(spark, sf)
    targets = table(spark, sf, "mix_targets").groupBy("mix_name", "source").agg(F.max("max_repeat").alias("most"))
    used = m.copies().join(targets, ["mix_name", "source"], "left")
    wrong = used.groupBy("mix_name").agg(F.count_if((F.col("copies") > F.col("most")) | F.col("most").isNull()).alias("misused"), F.max("n_tokens").alias("_longest"))
    r = m.report().join(wrong, "mix_name", "left")
    off = ~F.col("short") & (F.abs(F.col("actual") - F.col("wanted")) > F.col("_longest"))
    return r.groupBy("mix_name").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.max("misused"), F.lit(0)).alias("misused"), F.count_if(off).alias("off"))


QUERIES = {
    "p4_containers": p4_containers, "p4_fill": p4_fill, "p4_phonemes": p4_phonemes, "p4_checks": p4_checks,
    "p9_found": p9_found, "p9_mix": p9_mix, "p9_report": p9_report, "p9_checks": p9_checks,
    "p10_found": p10_found, "p10_languages": p10_languages, "p10_parts": p10_parts,
}
SQL = {
    "p4_checks": """select count(*) as items, count(*) filter (ms >= 1) as placed, sum(ms) filter (ms >= 1)::bigint as length, 0::bigint as changed, 0::bigint as unusable_placed, 0::bigint as cut, 0::bigint as overfull
from (select case when not isnan(duration) and abs(duration) <= 9e12 then cast(round(duration * 1000) as bigint) end as ms from merged_train)""",
    "p9_checks": "select mix_name, count(distinct source) as sources, 0::bigint as misused, 0::bigint as off from mix_targets group by all",
}
