"""Ordered operators over transcript segments: neighbours, islands, repeated runs, sentences.

Rows of an entity (an episode) are ordered within chunks of time, and only one summary row for each chunk crosses
chunk borders, so a very long episode is spread over many tasks like many short ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.normalise import run_key

#: Seconds of a chunk, the largest pause inside a sentence, and the length of a run that is dropped.
CHUNK, MAX_GAP, RUN = 600.0, 0.8, 3


def chunked(df: DataFrame, start: str, chunk: float = CHUNK) -> DataFrame:
    """df with the chunk of time that start lies in; rows without a start come in a last one."""
    at = F.when(F.col(start).isNull() | F.isnan(start), F.lit(1 << 40)).otherwise(F.floor(F.col(start) / chunk))
    return df.withColumn("_chunk", at.cast("long"))


def with_previous(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """df (see chunked) with a struct _prev of the columns of the row before it in its key's order, NULL for the first.
    order is unique within a key."""
    value, place = F.struct(*columns), F.struct(*order)
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    local = df.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = df.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(F.max_by(value, place).alias("_last"))
    carried = last.select("_k", "_c", F.lag("_last").over(Window.partitionBy("_k").orderBy("_c")).alias("_carried"))
    j = local.join(carried, local[key].eqNullSafe(carried["_k"]) & (local["_chunk"] == carried["_c"]), "left")
    return j.withColumn("_prev", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_lag", "_first", "_k", "_c", "_carried")


def islands(df: DataFrame, key: str, order: list[str], begins: Column, out: str = "island") -> DataFrame:
    """df (see with_previous) with a number that grows by one at each row where begins holds, within a key's order."""
    w = Window.partitionBy(key, "_chunk").orderBy(*order)
    flagged = df.withColumn("_new", F.when(begins, 1).otherwise(0))
    local = flagged.withColumn("_local", F.sum("_new").over(w))
    sums = flagged.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(F.sum("_new").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_k", "_c", before.alias("_before"))
    j = local.join(sums, local[key].eqNullSafe(sums["_k"]) & (local["_chunk"] == sums["_c"]))
    return j.withColumn(out, F.col("_local") + F.col("_before")).drop("_new", "_local", "_k", "_c", "_before", "_prev")


def speech_only(df: DataFrame, text: str = "text", speaker: str = "speaker") -> DataFrame:
    """Segments that are neither music, nor of the speaker UNKNOWN, nor in a script foreign to German."""
    return df.where(~C.is_music(F.col(text)) & ~C.is_unknown_speaker(F.col(speaker)) & ~C.has_foreign_script(F.col(text)))


def drop_runs(df: DataFrame, key: str, order: list[str], start: str = "start", text: str = "text", run: int = RUN) -> DataFrame:
    """Without runs of `run` or more neighbouring segments with the same normalised text (functions.normalise.run_key);
    segments whose normalised text is empty stay. NULL texts count as empty."""
    d = chunked(df.withColumn("_text", run_key(F.col(text))), start)
    d = with_previous(d, key, order, ["_text"])
    d = islands(d, key, order, F.col("_prev").isNull() | (F.col("_prev._text") != F.col("_text")), "_island")
    long = d.groupBy(F.col(key).alias("_k"), F.col("_island").alias("_i")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= run)
    gone = d[key].eqNullSafe(long["_k"]) & (d["_island"] == long["_i"]) & (d["_text"] != "")
    return d.join(long, gone, "left_anti").select(*df.columns)


def sentences(df: DataFrame, key: str, tie: str, max_gap: float = MAX_GAP) -> DataFrame:
    """(key, start, end, speaker, text, overlap_coverage): neighbouring segments of one speaker joined to sentences.

    In the order of start, end and tie a segment goes on with the sentence if the speaker is the same, the pause is at
    most max_gap and the text before does not end a sentence. A missing end or start makes the pause unknown and begins a
    sentence; speakers compare as text, NULL with NULL. start is that of the first segment, end that of the last,
    overlap_coverage the mean weighted with durations (0 without any); all three are rounded to 3 digits."""
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    d = df.select(F.col(key).alias("key"), clean("start").alias("start"), clean("end").alias("end"), F.coalesce("speaker", F.lit("")).alias("speaker"), F.coalesce(C.strip(F.col("text")), F.lit("")).alias("text"), F.coalesce(clean("overlap_coverage"), F.lit(0.0)).alias("ov"), F.col(tie).alias("tie"))
    order = ["start", "end", "tie"]
    d = with_previous(chunked(d, "start"), "key", order, ["speaker", "end", "text"])
    goes_on = (F.col("_prev.speaker") == F.col("speaker")) & (F.col("start") - F.col("_prev.end") <= max_gap) & ~C.ends_sentence(F.col("_prev.text"))
    d = islands(d, "key", order, ~F.coalesce(goes_on, F.lit(False)), "island")
    place = F.struct(*order)
    length = F.greatest(F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)), F.lit(0.0))
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"]), lambda t: t != "")
    g = d.groupBy("key", "island").agg(
        F.round(F.min_by("start", place), 3).alias("start"), F.round(F.max_by("end", place), 3).alias("end"), F.min_by("speaker", place).alias("speaker"),
        F.array_join(texts, " ").alias("text"), F.coalesce(F.round(F.sum(length * F.col("ov")) / F.nullif(F.sum(length), F.lit(0.0)), 3), F.lit(0.0)).alias("overlap_coverage"), F.count(F.lit(1)).alias("segments"),
    )
    return g.drop("island").withColumnRenamed("key", key)


def split_sentences(df: DataFrame, key: list[str], text: str, start: str, end: str) -> DataFrame:
    """One row for each sentence of a segment, the segment's time shared out by characters. A segment of one sentence
    keeps its times; one without text gives no row."""
    parts = F.filter(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda t: F.trim(t) != "")
    d = df.select(*key, parts.alias("_p"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("size(_p) > 0")
    cum = F.expr("transform(_p, (t, i) -> aggregate(slice(_p, 1, i), 0, (a, x) -> a + length(x)))")
    d = d.withColumn("_c", cum).withColumn("_all", F.expr("aggregate(_p, 0, (a, x) -> a + length(x))"))
    d = d.select(*key, "_s", "_e", "_all", F.posexplode(F.arrays_zip("_p", "_c")).alias("part", "_x"))
    at = lambda n: F.col("_s") + (F.col("_e") - F.col("_s")) * n / F.col("_all")
    return d.select(*key, "part", F.col("_x._p").alias("text"), at(F.col("_x._c")).alias("start"), at(F.col("_x._c") + F.length("_x._p")).alias("end"))
