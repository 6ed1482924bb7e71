"""Problem 4: items packed whole into containers of a fixed size.

Lexical retrieval packing: the items of an owner are sharded, each shard has an inverted BM25 index, and the longest
unused item of the shard is a seed whose best-scoring unused neighbours fill its container. When there is room for no
more than two further items, those that leave the least space are taken, better-scoring ones first among equals.

Document frequencies cover all items. Terms are hashed to TERMS numbers, so that the table of frequencies has a fixed
size; terms that share a number share their frequency. An owner with many items is split into shards of about SHARD
items by a hash of the item's key, so a frequent owner is no larger task than others.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.runtime import staged, width

TERMS, SHARD = 1 << 18, 512
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Numbers of the terms of a text, in order; an empty array for NULL."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(TERMS)).cast("int"))


class Index:
    """Inverted BM25 index of one shard."""

    def __init__(self, docs: list[list[int]], idf: np.ndarray, average: float):
        self.docs, self.postings = docs, {}
        for i, doc in enumerate(docs):
            if not doc:
                continue
            norm = K1 * (1 - B + B * len(doc) / average)
            tf: dict[int, int] = {}
            for t in doc:
                tf[t] = tf.get(t, 0) + 1
            for t, n in tf.items():
                self.postings.setdefault(t, []).append((i, float(idf[t]) * n * (K1 + 1) / (n + norm)))

    def neighbours(self, seed: int, unused: list[bool]) -> list[int]:
        """Unused items that share a term with the seed, best first."""
        score: dict[int, float] = {}
        get = score.get
        for t in set(self.docs[seed]):
            for i, w in self.postings[t]:
                if unused[i]:
                    score[i] = get(i, 0.0) + w
        return sorted(score, key=lambda i: (-score[i], i))


def pack(lengths: list[int], docs: list[list[int]], capacity: int, idf: np.ndarray, average: float) -> list[list[int]]:
    """Containers of one shard as lists of item numbers; every length is in 1 .. capacity."""
    index = Index(docs, idf, average)
    n = len(lengths)
    unused = [True] * n
    free = sorted((lengths[i], i) for i in range(n))  # ascending; what is unused
    out = []

    def take(i: int) -> None:
        unused[i] = False
        at = bisect_right(free, (lengths[i], i)) - 1
        del free[at]

    while free:
        seed = free[-1][1]
        room = capacity - lengths[seed]
        take(seed)
        held = [seed]
        if free and free[0][0] <= room:
            near = index.neighbours(seed, unused)
            mean = sum(x for x, _ in free) / len(free)
            for i in near:
                if room <= 2.5 * mean:
                    break
                if unused[i] and lengths[i] <= room:
                    take(i)
                    held.append(i)
                    room -= lengths[i]
            while free and free[0][0] <= room:
                # the one or two items that leave the least room; the first of two is any near neighbour or the largest
                at = bisect_right(free, (room, n)) - 1
                firsts = np.array([*(i for i in near if unused[i] and lengths[i] <= room), free[at][1]])
                size, rest = np.array([x for x, _ in free]), np.array([i for _, i in free])
                first = np.array([lengths[i] for i in firsts.tolist()])
                j = np.searchsorted(size, room - first, side="right") - 1
                j -= (j >= 0) & (rest[j] == firsts)
                both = first + np.where(j >= 0, size[j], 0)
                best = int(both.argmax())  # the best neighbour among equals
                pick = (int(firsts[best]), int(rest[j[best]])) if j[best] >= 0 else (int(firsts[best]),)
                if room > 2.5 * mean and len(pick) == 1:
                    pick = (free[at][1],)
                for i in pick:
                    take(i)
                    held.append(i)
                    room -= lengths[i]
        out.append(held)
    return out


def containers(items: DataFrame, key: str, owner: Column, length: Column, text: Column, capacity: int) -> DataFrame:
    """(owner, container, key, piece, at, length): the place of every item, or of every piece of it.

    length is a whole number of units. An item longer than capacity is cut into pieces of that size, each alone in its
    container, and a remainder that is packed like an item; other items are never cut. An item whose length is NULL or
    below one unit has no place: its container, at and length are NULL and its piece is 0. Items without an owner are
    packed among themselves. Repeated rows are items of their own if their keys differ. Every row of items comes out.

    container is unique over all; at is where the item begins in it."""
    spark = items.sparkSession
    x = items.select(F.col(key).alias("key"), F.coalesce(owner, F.lit("")).alias("owner"), length.cast("long").alias("length"), terms(text).alias("terms"))
    usable = x.where("length >= 1")
    # frequencies of all items' terms, with the totals on each item's first term; at most TERMS rows reach the driver
    each = usable.select(F.size("terms").alias("n"), F.posexplode(F.array_distinct("terms")).alias("pos", "term"))
    first = F.col("pos") == 0
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("tokens"), F.count_if(first).alias("docs")).toPandas()
    docs = int(df["docs"].sum())
    count = np.zeros(TERMS)
    count[df["term"].to_numpy(int)] = df["df"].to_numpy(float)
    idf = spark.sparkContext.broadcast(np.log1p((docs - count + 0.5) / (count + 0.5)).astype(np.float32))
    average = float(df["tokens"].sum()) / max(docs, 1)

    many = staged(usable.groupBy("owner").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SHARD), "large-owners")
    s = usable.join(many, "owner", "left")
    s = s.withColumn("shard", F.when(F.col("c").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / SHARD))).cast("int")).drop("c")
    s = s.repartition(width(items), "owner", "shard").sortWithinPartitions("owner", "shard", "key")
    kind = items.schema[key].dataType.simpleString()
    schema = f"owner string, container string, key {kind}, piece int, at long, length long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out, type_ = None, [], [[], [], [], [], [], []], None

        def put(*row) -> None:
            for c, v in zip(out, row):
                c.append(v)

        def flush() -> None:
            if not held:
                return
            owner, shard = group
            name, no = f"{owner}#{shard}", 0
            lengths, docs, which = [], [], []
            for k, size, doc in held:
                whole, rest = divmod(size, capacity)
                if size > capacity:
                    for p in range(whole):
                        put(owner, f"{name}#{no}", k, p, 0, capacity)
                        no += 1
                    if rest:
                        lengths.append(rest)
                        docs.append(doc)
                        which.append((k, whole))
                else:
                    lengths.append(size)
                    docs.append(doc)
                    which.append((k, 0))
            for box in pack(lengths, docs, capacity, idf.value, average or 1.0):
                at = 0
                for i in box:
                    put(owner, f"{name}#{no}", which[i][0], which[i][1], at, lengths[i])
                    at += lengths[i]
                no += 1

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), type_, pa.int32(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["owner", "container", "key", "piece", "at", "length"])
            for c in out:
                c.clear()
            return made

        for b in batches:
            type_ = b.column("key").type
            for o, sh, k, size, doc in zip(*(b.column(c).to_pylist() for c in ("owner", "shard", "key", "length", "terms"))):
                if (o, sh) != group:
                    flush()
                    group, held = (o, sh), []
                held.append((k, size, doc))
            if len(out[0]) > 10_000:
                yield batch()
        flush()
        if out[0]:
            yield batch()

    placed = s.select("owner", "shard", "key", "length", "terms").mapInArrow(run, schema)
    null = F.lit(None)
    rest = x.where("length is null or length < 1").select("owner", null.cast("string").alias("container"), "key", F.lit(0).alias("piece"), null.cast("long").alias("at"), null.cast("long").alias("length"))
    return placed.unionByName(rest).withColumnRenamed("key", key)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, used and unused units, share filled, the least number of containers that any packing needs,
    items without a place."""
    own = placed.groupBy("owner", "container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("_n"))
    per = own.groupBy("owner").agg(F.count("container").alias("containers"), F.sum("used").alias("used"), F.sum(F.when(F.col("container").isNull(), F.col("_n"))).alias("unplaced"))
    return per.agg(
        F.sum("containers").alias("containers"), F.sum("used").alias("used"), (F.sum("containers") * capacity - F.sum("used")).alias("unused"),
        (F.sum("used") / F.nullif(F.sum("containers") * capacity, F.lit(0))).alias("filled"), F.sum(F.ceil(F.col("used") / capacity)).alias("least_containers"),
        F.coalesce(F.sum("unplaced"), F.lit(0)).alias("unplaced"),
    )
