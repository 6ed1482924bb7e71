"""Greedy chunks of ordered items bounded by a total, for keys of any size.

A chunk's borders depend on where the chunk before it ended, so a key's items must be walked in order. A key with many
items is cut into blocks at items chosen by a hash, and the blocks are walked at the same time: a block does not know
the open chunk it inherits, but once the first chunk begins inside it, the rest follows from the place of that
beginning alone. So each block is summed up as a table: for every item near its beginning, the open chunk at the
block's end if the first chunk began there. The tables of a key, a few rows for each block, are chained to find what
every block inherits, and the blocks then number their chunks on their own.

Policies: `pre` begins a new chunk with the item that would take a non-empty chunk above the target; `post` ends a chunk
with the item that takes it to the target or above. Sums are made item by item in order, as in a plain loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mundspark.runtime import staged, width

#: Items of a block on average; keys with no more than twice as many are one block.
BLOCK = 20_000


def _begins(policy: str, total: float | None, d: float, target: float) -> bool:
    """Whether the next item, of size d, begins a chunk; total is that of the open chunk, None without one."""
    if total is None:
        return True
    return total + d > target if policy == "pre" else total >= target


def walk(sizes: list[float], target: float, policy: str, total: float | None = None) -> tuple[list[int], float | None]:
    """Number of chunks begun up to and with each item, and the total of the open chunk at the end."""
    out, n = [], 0
    for d in sizes:
        if _begins(policy, total, d, target):
            n, total = n + 1, d
        else:
            total += d
        out.append(n)
    return out, total


def block_table(sizes: list[float], target: float, policy: str) -> tuple[list[float], list[float], list[int]]:
    """(sizes, open totals, chunk counts) by the place of a block's first beginning: the sizes of the items up to the
    last place where it can be, and for each place the open total at the block's end and the chunks begun."""
    n = len(sizes)
    # the last place at which the first chunk can begin: that of a block which inherits an empty total
    last, total = n, 0.0
    for i, d in enumerate(sizes):
        if i and _begins(policy, total, d, target):
            last = i
            break
        total += d
    places = min(last + 1, n)
    ends: dict[int, tuple[float, int]] = {}  # what comes out of a chunk that begins at an item
    totals, counts = [0.0] * places, [0] * places
    for p in range(places):
        path, at, total = [], p, None
        while True:
            if at in ends:
                total, count = ends[at]
                break
            begin, total = at, sizes[at]
            path.append(begin)
            at += 1
            while at < n and not _begins(policy, total, sizes[at], target):
                total += sizes[at]
                at += 1
            if at >= n:
                count = 1
                ends[begin] = (total, 1)
                path.pop()
                break
        for begin in reversed(path):
            count += 1
            ends[begin] = (total, count)
        totals[p], counts[p] = ends[p]
    return sizes[:places], totals, counts


def chain(blocks: list[tuple[int, list[float], list[float], list[int]]], target: float, policy: str) -> list[tuple[int, float | None, int]]:
    """(block, inherited total, chunks before) of a key's blocks in order; a block comes with its number and its table.
    In a block whose table does not list all items, a chunk begins at one of those listed."""
    out, total, before = [], None, 0
    for number, sizes, totals, counts in blocks:
        out.append((number, total, before))
        for i, d in enumerate(sizes):
            if _begins(policy, total, d, target):
                total, before = totals[i], before + counts[i]
                break
            total += d
    return out


def greedy_chunks(df: DataFrame, keys: list[str], order: list[str], size: Column, target: float, policy: str = "pre", block: int = BLOCK) -> DataFrame:
    """df with a column chunk, from 0 in each key. Rows are walked by order, whose last column should be unique within a
    key; size is a number; NULL and negative ones count as 0. A single item above the target is a chunk of its own under `pre`. NULL
    keys are a key. target must be positive."""
    if target <= 0:
        raise ValueError("the target must be positive")
    n = width(df)
    row = df.withColumn("_size", F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0)))
    counts = row.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 2 * block)
    many = staged(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "large-keys")
    place = F.struct(*[F.col(c) for c in order])
    if many.isEmpty():
        row = row.withColumn("_block", F.lit(0))
        return _number(row.repartition(n, *keys), keys, order, target, policy, None).drop("_size", "_block")
    # large keys: blocks begin at the items that a hash picks, about one in `block`
    names = [f"_k{i}" for i in range(len(keys))]
    same = lambda a, b: _all([a[k].eqNullSafe(b[x]) for k, x in zip(keys, names)])
    marks = row.where(F.pmod(F.xxhash64(*keys, *order), F.lit(block)) == 0)
    marks = marks.join(many, same(marks, many), "left_semi").groupBy(*[F.col(k).alias(x) for k, x in zip(keys, names)]).agg(F.array_sort(F.collect_list(place)).alias("_marks"))
    marks = staged(marks, "block-marks")
    j = row.join(marks, same(row, marks), "left").drop(*names)
    j = j.withColumn("_block", F.coalesce(F.size(F.filter("_marks", lambda m: m <= place)), F.lit(0))).drop("_marks")
    j = j.withColumn("_block", F.greatest("_block", F.lit(0))).repartition(n, *keys, "_block")
    tables = _tables(j, keys, order, target, policy)
    return _number(j, keys, order, target, policy, tables).drop("_size", "_block")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first columns, of sorted batches."""
    key, held = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != key:
                if held:
                    yield key, held
                key, held = r[:keys], []
            held.append(r)
    if held:
        yield key, held


def _tables(j: DataFrame, keys: list[str], order: list[str], target: float, policy: str) -> DataFrame:
    """(keys, _block, _in, _before): what every block inherits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    k = len(keys) + 1
    fields = [j.schema[c] for c in keys]
    schema = T.StructType([*fields, T.StructField("_block", T.IntegerType()), T.StructField("_t", T.StringType())])
    arrow = to_arrow_schema(schema)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for key, held in _groups(batches, k):
            sizes = [r[-1] for r in held]
            first, totals, counts = block_table(sizes, target, policy)
            t = json.dumps([first, totals, counts])
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, t), arrow)], schema=arrow)

    sums = staged(j.sortWithinPartitions(*keys, "_block", *order).select(*keys, "_block", "_size").mapInArrow(sum_up, schema), "block-tables")
    out = T.StructType([*fields, T.StructField("_block", T.IntegerType()), T.StructField("_in", T.DoubleType()), T.StructField("_before", T.LongType())])
    arrow_out = to_arrow_schema(out)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for key, held in _groups(batches, k - 1):
            blocks = [(r[-2], *json.loads(r[-1])) for r in held]
            got = [(*key, *x) for x in chain(blocks, target, policy)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), arrow_out)], schema=arrow_out)

    return staged(sums.repartition(width(sums), *keys).sortWithinPartitions(*keys, "_block").mapInArrow(link, out), "block-links")


def _number(row: DataFrame, keys: list[str], order: list[str], target: float, policy: str, tables: DataFrame | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    if tables is None:
        j = row.withColumn("_in", F.lit(None).cast("double")).withColumn("_before", F.lit(0).cast("long"))
    else:
        t = tables.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate([*keys, "_block"])], "_in", "_before")
        on = _all([row[c].eqNullSafe(t[f"_j{i}"]) for i, c in enumerate([*keys, "_block"])])
        j = row.join(t, on).select(*row.columns, "_in", "_before")
    j = j.sortWithinPartitions(*keys, "_block", *order) if tables is None else j.repartition(width(row), *keys, "_block").sortWithinPartitions(*keys, "_block", *order)
    cols = [c for c in row.columns]
    schema = T.StructType([*[row.schema[c] for c in cols], T.StructField("chunk", T.LongType())])
    arrow = to_arrow_schema(schema)
    at = {c: i for i, c in enumerate(cols)}
    ks = [at[c] for c in [*keys, "_block"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n = object(), None, 0
        for b in batches:
            groups = zip(*(b.column(i).to_pylist() for i in ks))
            sizes, ins, before = b.column(at["_size"]).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            out = []
            for g, d, t, m in zip(groups, sizes, ins, before):
                if g != key:
                    key, total, n = g, t, m
                if _begins(policy, total, d, target):
                    n, total = n + 1, d
                else:
                    total += d
                out.append(n - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(out, pa.int64())], schema=arrow)

    return j.select(*cols, "_in", "_before").mapInArrow(run, schema)


def chunk_documents(df: DataFrame, keys: list[str], order: list[str], chunk: str = "chunk", text: str = "text", size: str = "_d", drop: tuple[str, ...] = ()) -> DataFrame:
    """One row a chunk: its items, total size, and the texts in order joined by spaces. Tokens in drop are left out of
    the text, not of the size. A chunk is bounded by its target, so its rows may be gathered."""
    item = F.struct(*[F.col(c) for c in order], F.col(text).alias("_text"))
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"])
    texts = F.filter(texts, lambda t: t.isNotNull() & ~F.trim(t).isin("", *drop))
    return df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("items"), F.sum(size).alias("total"), F.array_join(texts, " ").alias("document"))


def _earliest(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key by order. Parts of a key, by a hash of the order, are ranked alone, and only the
    first rows of the parts are ranked together; the first `most` of a key are among them."""
    part = F.pmod(F.xxhash64(*order), F.lit(64))
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    near = df.withColumn("_part", part).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_part")


def cycled(df: DataFrame, keys: list[str], order: list[str], size: Column, text: str, target: float, most: int = 10_000, block: int = BLOCK) -> DataFrame:
    """One row a document for each key: the chunks of a key whose items reach the target, else one document of its
    items repeated in turn until they do (at most `most` items; items without a size count 5); a key whose sizes sum to
    nothing gives twelve items in turn. Only keys below the target are gathered, whose items of known size are few."""
    d = df.withColumn("_d", F.greatest(F.coalesce(size.cast("double"), F.lit(0.0)), F.lit(0.0)))
    total = d.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_d").alias("_total"))
    j = d.join(total, _all([d[k].eqNullSafe(total[f"_k{i}"]) for i, k in enumerate(keys)])).drop(*[f"_k{i}" for i in range(len(keys))])
    used = F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.lit(5.0))
    long = greedy_chunks(j.where(F.col("_total") >= target).withColumn("_d", used), keys, order, F.col("_d"), target, "pre", block)
    long = chunk_documents(long, keys, order, "chunk", text, "_d").select(*keys, "chunk", "items", "document")
    # no more than `most` items can be used, whatever the key has
    few = _earliest(j.where(F.col("_total") < target), keys, order, most)
    item = F.struct(F.struct(*order).alias("_r"), used.alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    packed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("i"), F.max("_total").alias("_total"))
    once = "aggregate(i, 0D, (a, x) -> a + x.d)"
    # whole turns that stay below the target, then items until it is reached
    turns = F.expr(f"least(greatest(cast(ceil({target}D / {once}) as int) - 1, 0), cast({most} / size(i) as int))")
    more = F.expr(f"""aggregate(i, named_struct('a', _turns * {once}, 'n', 0),
        (s, x) -> case when s.a < {target}D then named_struct('a', s.a + x.d, 'n', s.n + 1) else s end).n""")
    packed = packed.withColumn("_turns", turns).withColumn("_n", F.least(F.col("_turns") * F.size("i") + more, F.lit(most)))
    packed = packed.withColumn("_n", F.when(F.col("_total") <= 0, 12).otherwise(F.col("_n")))
    text_ = F.expr("array_join(transform(sequence(0, _n - 1), k -> i[cast(k % size(i) as int)].t), ' ')")
    return long.unionByName(packed.select(*keys, F.lit(0).cast("long").alias("chunk"), F.col("_n").cast("long").alias("items"), text_.alias("document")))
