"""Streams: events joined to sessions by their pauses, running summaries, and greedy chunks with kept state.

Late rows are dropped once the watermark has passed them; state of a session or chunk is let go with the watermark, so it
is bounded by the keys that are active within it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str, value: str) -> DataFrame:
    """(key, start, end, events, total): events of a key no further apart than gap; sent once the watermark is past."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    g = w.agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "total")


def summaries(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std, most): running per-key summaries, for the update or complete mode; the deviation is of the
    population."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("most"))


def windowed(events: DataFrame, time: str, width: str, late: str, group: str, value: str) -> DataFrame:
    """(start, group, n, total) of tumbling windows."""
    g = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), group, "n", "total")


def rolling_chunks(events: DataFrame, key: str, order: str, size: str, target: float, time: str, late: str) -> DataFrame:
    """(key, chunk, items, total): chunks that end with the item that takes them to the target, over all batches of a
    stream; rows of a batch are taken by order. What is left of a key is sent when the watermark has passed its last
    row."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, items, total = state.get if state.exists else (0, 0, 0.0)
        if state.hasTimedOut:
            state.remove()
            if items:
                yield pd.DataFrame({key: [k[0]], "chunk": [chunk], "items": [items], "total": [total]})
            return
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for d in rows[size].fillna(0.0):
            items, total = items + 1, total + float(d)
            if total >= target:
                out.append((k[0], chunk, items, total))
                chunk, items, total = chunk + 1, 0, 0.0
        state.update((chunk, items, total))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "chunk", "items", "total"])

    marked = events.withWatermark(time, late)
    return marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, chunk long, items long, total double", "chunk long, items long, total double", "append", GroupStateTimeout.EventTimeTimeout)
