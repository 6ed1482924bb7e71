"""Segments of transcripts: redelivered rows removed, cleaned, in order and cut into pieces of bounded size; and the
parallel prefix merge that joins runs over the borders of pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.llm.cleaning import clean_segment, shape
from mundspark.operators.intervals import to_ms
from mundspark.operators.transcript import islands, with_previous
from mundspark.runtime import width

#: Milliseconds of one chunk of an episode, and the most segments that are held at once.
CHUNK_MS, PIECE = 600_000, 4096
#: Chunk of segments without a start, which come last.
_NO_START = 1 << 40

CLEAN = "episode_id long, chunk long, start_ms long, end_ms long, segment_id long, speaker_no int, text string, words string, shape int"


def piece_chunk() -> Column:
    """The chunk of its episode that a segment's start lies in."""
    return F.coalesce(F.floor(to_ms(F.col("start")) / CHUNK_MS), F.lit(_NO_START))


def in_order(rows: list[tuple]) -> list[tuple]:
    """Rows of one chunk (schema CLEAN) by start, those without one last, and segment_id."""
    return sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[4]))


def clean_segments(segments: DataFrame) -> DataFrame:
    """The segments with speech (schema CLEAN), once each, sorted by episode, chunk, start and segment_id within
    partitions; all segments of a chunk are in one partition.

    Rows equal in all columns but segment_id and ingested_at count once, under the lowest segment_id. end_ms is NULL
    where end is NULL, NaN or not after start. speaker_no is NULL if no speaker is named; shape: see cleaning.shape."""
    start = to_ms(F.col("start"))
    chunk = piece_chunk().alias("chunk")
    cols = ["episode_id", "podcast", "start", "end", "speaker", "text", "overlap_coverage"]
    s = segments.where("text is not null").select(chunk, "segment_id", *cols).repartition(width(segments), "episode_id", "chunk")
    once = s.groupBy("chunk", *cols).agg(F.min("segment_id").alias("segment_id"))
    end = to_ms(F.col("end"))
    once = once.select("episode_id", "chunk", start.alias("start_ms"), F.when(end > start, end).alias("end_ms"), "segment_id", "speaker", "text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [clean_segment(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("speaker").to_pylist())]
            got = [(n, t, w, shape(t)) if w else (n, "", "", 0) for n, t, w in got]
            number, text, words, form = zip(*got) if got else ((), (), (), ())
            cols = [b.column(c) for c in ("episode_id", "chunk", "start_ms", "end_ms", "segment_id")]
            out = pa.RecordBatch.from_arrays([*cols, pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(words, pa.string()), pa.array(form, pa.int32())], names=["episode_id", "chunk", "start_ms", "end_ms", "segment_id", "speaker_no", "text", "words", "shape"])
            yield out.filter(pa.array([bool(w) for w in words], pa.bool_()))

    return once.sortWithinPartitions("episode_id", "chunk", F.asc_nulls_last("start_ms"), "segment_id").mapInArrow(clean, CLEAN)


def by_piece(rows: DataFrame, f: Callable[[list[tuple]], list[tuple]], schema: str, most: int | None = -1) -> DataFrame:
    """f over each piece: the segments of one episode and chunk in order, at most PIECE (or `most`) at a time. f gets tuples of the
    columns of rows, which begin with episode_id and chunk, and returns tuples; put before them are episode_id, chunk
    and piece."""
    most = PIECE if most == -1 else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, piece, out = None, [], 0, []

        def flush() -> None:
            if held:
                out.extend((*key, piece, *x) for x in f(held))

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:2] != key or (most is not None and len(held) >= most):
                    flush()
                    piece = piece + 1 if r[:2] == key else 0
                    key, held = r[:2], []
                held.append(r)
            if len(out) >= 10_000:
                yield batch(out)
                out = []
        flush()
        if out:
            yield batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    full = spark.createDataFrame([], "episode_id long, chunk long, piece int, " + schema).schema
    arrow = to_arrow_schema(full)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, full)


#: Chunks, and pieces of segments without a start, whose runs are merged by one task.
_SUPER, _SUPER_PIECES = 256, 1024


def merge_runs(local: DataFrame, same: Callable[[str, str], bool], head: str, tail: str) -> DataFrame:
    """Runs of whole episodes from the runs of pieces.

    local: episode_id, chunk, piece, run, is_first, is_last, first_segment_id, last_segment_id, n, start_ms, end_ms,
    text, and the columns head and tail that describe the first and the last segment of a run. Only the first and the
    last run of each piece can go on over its border. Those are merged by a prefix scan in two levels (see
    operators.transcript): within stretches of chunks, and over one row for each stretch. Each first run is compared with
    the last run before it, and a running count of those that do not go on numbers the merged runs. The others are final
    as they are."""
    cols = ["episode_id", "first_segment_id", "last_segment_id", "n", "start_ms", "end_ms", "text", head]
    inner = local.where("not is_first and not is_last").select(*cols)
    stretch = F.when(F.col("chunk") == _NO_START, F.lit(_NO_START) + F.floor(F.col("piece") / _SUPER_PIECES)).otherwise(F.floor(F.col("chunk") / _SUPER))
    order = ["chunk", "piece", "run"]
    edges = with_previous(local.where("is_first or is_last").withColumn("_chunk", stretch.cast("long")), "episode_id", order, [tail])
    equal = F.pandas_udf(lambda a, b: pd.Series([x is not None and y is not None and bool(same(x, y)) for x, y in zip(a, b)], dtype=bool), "boolean")
    goes_on = F.when(F.col("is_first") & F.col("_prev").isNotNull(), equal(F.col(f"_prev.{tail}"), F.col(head))).otherwise(F.lit(False))
    edges = islands(edges.withColumn("_on", goes_on), "episode_id", order, ~F.col("_on"), "_group")
    at = F.struct(*order)
    merged = edges.groupBy("episode_id", "_group").agg(
        F.min_by("first_segment_id", at).alias("first_segment_id"), F.max_by("last_segment_id", at).alias("last_segment_id"), F.sum("n").alias("n"),
        F.min_by("start_ms", at).alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("text", at).alias("text"), F.min_by(head, at).alias(head),
    )
    return inner.unionByName(merged.select(*cols))
