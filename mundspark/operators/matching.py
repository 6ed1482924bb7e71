"""Joins that are no plain equality: containment of strings, first match, best match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mundspark.operators.rows import first_row
from mundspark.runtime import staged

#: Characters of the shared piece by which containing strings find each other; bits of the map of pieces that are looked for,
#: which some 8 M pieces fill so that it lets everything through, and bits of each of its parts (fixed by Spark).
PIECE, BITS, PART = 12, 1 << 23, 1 << 15


def _pieces(c: str, lengths: str) -> str:
    """The different pieces of a text that have one of some lengths, an expression giving an array of those."""
    return f"array_distinct(flatten(transform(filter({lengths}, n -> n <= length({c})), n -> transform(sequence(1, length({c}) - n + 1), i -> substr({c}, i, n)))))"


def _rarest(texts: DataFrame, c: str) -> DataFrame:
    """texts with the piece, of PIECE characters (all of a shorter text), that fewest other texts have."""
    own = texts.withColumn("_piece", F.explode(F.expr(_pieces(c, f"array(least(length({c}), {PIECE}))"))))
    n = own.groupBy("_piece").agg(F.count(F.lit(1)).alias("_c"))
    best = own.select(F.col(c).alias("_k"), "_piece").join(n, "_piece").groupBy("_k").agg(F.min_by("_piece", F.struct("_c", "_piece")).alias("_piece"))
    return texts.join(best, F.col(c) == F.col("_k")).drop("_k")


def _offering(texts: DataFrame, c: str, lengths: str, wanted: DataFrame) -> DataFrame:
    """texts with _pieces, the hashes of those pieces that wanted, a table with _piece, may have; texts without any are left
    out, before anything is shuffled."""
    spark = texts.sparkSession
    slot = F.pmod("_piece", F.lit(BITS))
    parts = wanted.groupBy((slot / PART).cast("int").alias("part")).agg(F.bitmap_construct_agg(slot % PART).alias("bits"))
    words = np.zeros((BITS // PART, PART // 8), np.uint8)
    for r in parts.collect():
        words[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    known = spark.sparkContext.broadcast(words.ravel())
    hashed = texts.withColumn("_pieces", F.transform(F.expr(_pieces(c, lengths)), lambda x: F.xxhash64(x)))

    def hits(batches):
        for b in batches:
            lists = b.column("_pieces")
            offsets, h = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            at = h.astype(np.int64) & (BITS - 1)
            hit = (known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))[hit]
            n = np.bincount(row, minlength=b.num_rows)
            some = np.flatnonzero(n)
            kept = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n[some])].astype(np.int32), pa.array(h[hit], pa.int64()))
            rest = b.select([x for x in b.schema.names if x != "_pieces"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*rest.columns, kept], [*rest.schema.names, "_pieces"])

    return hashed.mapInArrow(hits, T.StructType([T.StructField(f.name, f.dataType) for f in texts.schema] + [T.StructField("_pieces", T.ArrayType(T.LongType()))]))


def contains_join(a: DataFrame, b: DataFrame, a_text: str, b_text: str, b_order: str) -> DataFrame:
    """a with the columns of the first row of b, by b_order, whose text contains that of a or is contained in it; NULLs
    where none does. Texts shorter than one character match nothing.

    Where x contains y, every piece of y is a piece of x. So the shorter side offers its rarest piece, the longer one its
    pieces of that length that a bitmap of those knows, and an equality join of hashes finds the pairs to test: what many
    texts share (a common folder, a file type) makes no pairs. A text longer than all of the other side is in none of them.
    Texts are matched once each. Columns of a and b must have different names."""
    ta = a.select(F.col(a_text).alias("_x")).where(F.length("_x") > 0).distinct()
    tb = b.where(F.length(b_text) > 0)
    longest = lambda d, c: d.agg(F.coalesce(F.max(F.length(c)), F.lit(0))).first()[0]
    # no more than PIECE lengths occur
    lengths = lambda d, c: "cast(array(" + ", ".join(sorted(str(r[0]) for r in d.select(F.least(F.length(c), F.lit(PIECE))).distinct().collect())) + ") as array<int>)"
    most_a, most_b = longest(ta, "_x"), longest(tb, b_text)
    rarest = lambda d, c: staged(_rarest(d, c).withColumn("_piece", F.xxhash64("_piece")), "rarest")
    short_a = rarest(ta.where(F.length("_x") <= most_b), "_x")
    short_b = rarest(first_row(tb.where(F.length(b_text) <= most_a), [b_text], [F.col(b_order)]), b_text)
    long_b = first_row(_offering(tb, b_text, lengths(short_a, "_x"), short_a), [b_text], [F.col(b_order)])
    long_a = _offering(ta, "_x", lengths(short_b, b_text), short_b)
    each = lambda d: d.withColumn("_piece", F.explode("_pieces")).drop("_pieces")
    in_b = short_a.join(each(long_b), "_piece").where(F.contains(F.col(b_text), F.col("_x")))
    in_a = each(long_a).join(short_b, "_piece").where(F.contains(F.col("_x"), F.col(b_text)))
    row = F.struct(*[F.col(c) for c in b.columns])
    found = in_b.select("_x", row.alias("_r")).unionByName(in_a.select("_x", row.alias("_r")))
    best = found.groupBy("_x").agg(F.min_by("_r", f"_r.{b_order}").alias("_r"))
    return a.join(best, F.col(a_text) == F.col("_x"), "left").select(*[a[c] for c in a.columns], "_r.*")


def chunk_id(path: Column, mark: str = "concat_") -> Column:
    """The id of a joined chunk that follows `mark` in a path, without its file type; NULL where there is none."""
    return F.nullif(F.regexp_extract(path, rf"{mark}([^/.]+)", 1), F.lit(""))


def contains_or_id_join(a: DataFrame, b: DataFrame, a_text: str, b_text: str, b_order: str, mark: str = "concat_") -> DataFrame:
    """contains_join, and for the texts of a without a match the first row of b, by b_order, with the same chunk_id."""
    by_text = contains_join(a, b, a_text, b_text, b_order)
    left = by_text.where(F.col(b_text).isNull()).select(*a.columns)
    ids = first_row(b.withColumn("_id", chunk_id(F.col(b_text), mark)).where("_id is not null"), ["_id"], [F.col(b_order)])
    by_id = left.withColumn("_id", chunk_id(F.col(a_text), mark)).join(ids, "_id", "left").drop("_id")
    return by_text.where(F.col(b_text).isNotNull()).unionByName(by_id)
