"""Which rows stay: deduplication with a defined winner, ranked and seeded samples, folds, splits, quotas.

"Random" choices go by a hash of the row's key and a seed, so they are the same in any partitioning and on any run. The
hash is MD5, which other engines compute alike. Groups that may be large are cut by prefix.first_n, or by the heap of a
sort with limit, never by collecting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.operators.prefix import BUCKETS, first_n, running_before


def seeded(key: Column, seed: int) -> Column:
    """MD5 of seed and key: the order of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_unit(digest: Column) -> Column:
    """An MD5 digest as a value in [0, 1), of the same order."""
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / F.lit(float(16**13))


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order; rows with NULL keys are one group. An aggregation with map-side combine: no
    window sorts a large group."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("_r.*")


def last_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by order. A struct's NULL fields come first, so give unparsable values that should win a
    leading isNull field."""
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("_r.*")


def top(df: DataFrame, n: int, ranks: list[Column], key: str, seed: int = 42) -> DataFrame:
    """The n rows that rank best; ties by a seeded shuffle of the key, then the key."""
    return df.orderBy(*ranks, seeded(F.col(key), seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group (no NULL), by a seeded shuffle."""
    h = df.where(F.col(group).isNotNull()).withColumn("_h", seeded(F.col(key), seed)).withColumn("_u", hash_unit(F.col("_h")))
    quota = h.select(group).distinct().withColumn("_n", F.lit(n))
    return first_n(h.withColumn("_t", F.struct("_h", key)), [group], "_u", "_t", quota, "_n").drop("_h", "_u", "_t")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 13) -> DataFrame:
    """df with a column fold in 0 .. k - 1; each label's rows (no NULL) are dealt to the folds in turn in seeded order. A
    row's place is found by counting, so a label with most of the rows is no single task."""
    h = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_u", hash_unit(F.col("_h"))).withColumn("_t", F.struct("_h", key)).withColumn("_one", F.lit(1))
    return running_before(h, [label], "_u", "_t", "_one", "_place").select(*df.columns, F.pmod(F.col("_place"), F.lit(k)).cast("int").alias("fold"))


def holdout(df: DataFrame, key: str, share: float, at_least_one: bool = True, seed: int = 42) -> DataFrame:
    """df with a boolean is_eval: about a share of the rows by a seeded shuffle, exactly floor(n * share) of them; at
    least one of a table with rows if asked for."""
    h = df.withColumn("_h", seeded(F.col(key), seed)).withColumn("_b", F.floor(hash_unit(F.col("_h")) * BUCKETS).cast("int"))
    counts = sorted((r[0], r[1]) for r in h.groupBy("_b").agg(F.count(F.lit(1))).collect())  # at most BUCKETS rows
    n = int(sum(c for _, c in counts) * share)
    n = max(1, n) if at_least_one and counts else n
    cut, rest = BUCKETS, 0  # buckets below cut are held out whole, and so many rows of the bucket at cut
    for bucket, c in counts:
        if n < c:
            cut, rest = bucket, n
            break
        n -= c
    edge = h.where(F.col("_b") == cut).orderBy("_h", key).limit(rest).select(F.col(key).alias("_k"), F.lit(True).alias("_e"))
    held = (F.col("_b") < cut) | F.coalesce("_e", F.lit(False))
    return h.join(edge, F.col(key) == F.col("_k"), "left").select(*df.columns, held.alias("is_eval"))


def fill_quotas(pools: list[tuple[str, DataFrame, DataFrame | None, int]], key: str, ranks: list[Column], seed: int = 42) -> DataFrame:
    """Splits filled one after another: (split, pool, fallback pool, size) each take the best-ranked rows that no split
    before has taken, first from the pool, then, while rows lack, from the fallback. Adds a column split. Each split is
    taken by a sort with limit; `size` rows of it are kept to exclude them from the next."""
    from mundspark.runtime import staged

    used, out = None, None
    for split, pool, fallback, size in pools:
        part = None
        for source in (pool, fallback):
            lack = size if part is None else size - part.count()
            if source is None or lack <= 0:
                continue
            free = source if used is None else source.join(used, key, "left_anti")
            free = free if part is None else free.join(part.select(key), key, "left_anti")
            got = staged(top(free, lack, ranks, key, seed), "quota")
            part = got if part is None else part.unionByName(got)
        if part is None:
            continue
        used = part.select(key) if used is None else used.unionByName(part.select(key))
        part = part.withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def unless_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those already processed; NULL keys stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def deal_longest_first(df: DataFrame, size: str, key: str, workers: int) -> DataFrame:
    """df with a column worker: rows dealt to the workers in turn, the largest first (NULL sizes last), ties by key. Places
    are found by counting, so no task sorts the whole table."""
    top = df.agg(F.max(size)).first()[0]
    share = F.least(F.greatest(F.coalesce(1 - F.col(size) / F.lit(float(top or 1) + 1.0), F.lit(1.0)), F.lit(0.0)), F.lit(1 - 1e-12))
    d = df.withColumn("_u", share).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1)).withColumn("_t", F.struct(-F.col(size), F.col(key)))
    return running_before(d, ["_all"], "_u", "_t", "_one", "_place").select(*df.columns, F.pmod(F.col("_place"), F.lit(workers)).cast("int").alias("worker"))
