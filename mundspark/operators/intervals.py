"""Interval operators: continuous periods and gaps, attribution by overlap, multiplicity coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mundspark.runtime import staged

#: Ticks in one shard of a run bitmap, and shards of an entity that one task scans.
SHARD, STRETCH = 1 << 16, 4096


def to_ms(c: Column) -> Column:
    """Seconds to whole milliseconds; NULL, NaN and what no clock reaches (above 9e12 s) give NULL."""
    return F.when(F.abs(c) <= 9e12, F.round(c * 1000).cast("long"))


def run_bitmap(df: DataFrame, entity: str, start: str, end: str, shard: int = SHARD) -> DataFrame:
    """Compressed run bitmaps: (entity, shard, runs), runs being the sorted, disjoint, half-open stretches of set ticks
    that begin in the shard. Ticks are whole numbers; rows whose end is not after their start set none.

    An interval sets bits from its start to the end of its shard, from the start of its last shard to its end, and, if
    it covers whole shards between, one run for all of those, so a very long interval costs three pieces. Pieces with
    the same start are reduced to the longest before the shuffle; a shard therefore gathers at most `shard` of them,
    however many rows the entity has."""
    s0, s1 = F.floor(F.col("_s") / shard), F.floor((F.col("_e") - 1) / shard)
    pieces = F.when(
        F.col("_s0") == F.col("_s1"), F.array(F.struct(F.col("_s0").alias("shard"), F.col("_s").alias("s"), F.col("_e").alias("e")))
    ).otherwise(
        F.array(
            F.struct(F.col("_s0").alias("shard"), F.col("_s").alias("s"), ((F.col("_s0") + 1) * shard).alias("e")),
            F.struct((F.col("_s0") + 1).alias("shard"), ((F.col("_s0") + 1) * shard).alias("s"), (F.col("_s1") * shard).alias("e")),
            F.struct(F.col("_s1").alias("shard"), (F.col("_s1") * shard).alias("s"), F.col("_e").alias("e")),
        )
    )
    parts = (
        df.select(F.col(entity).alias("entity"), F.col(start).alias("_s"), F.col(end).alias("_e"))
        .where(F.col("_e") > F.col("_s"))
        .select("entity", "_s", "_e", s0.alias("_s0"), s1.alias("_s1"))
        .select("entity", F.inline(pieces))
        .where("e > s")
    )
    longest = parts.groupBy("entity", "shard", "s").agg(F.max("e").alias("e"))
    # union of the sorted pieces: a piece that begins at or before the furthest end so far goes on with the run
    w = Window.partitionBy("entity", "shard").orderBy("s")
    far = longest.withColumn("_far", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_far").isNull() | (F.col("s") > F.col("_far")), 1).otherwise(0)
    runs = far.withColumn("_run", F.sum(new).over(w)).groupBy("entity", "shard", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("entity", "shard").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, shard: int = SHARD, stretch: int = STRETCH) -> DataFrame:
    """(entity, kind, start, end): the set runs (`period`) and the clear runs between them (`gap`) of each entity.

    Intervals that overlap, nest or touch form one period. A row whose start or end is NULL, or whose end is not after
    its start, has no interval; an entity without intervals gives no row. NULL entities form one entity. Repeated rows
    change nothing. start and end are whole numbers (see to_ms); other columns are ignored.

    Runs are built per entity and shard. What crosses shard borders is found by prefix scans, forwards for the furthest end
    so far and backwards for the next run that begins a period; both go over the shards of a stretch, and over one summary
    row for each stretch of an entity, so no task holds all of a long entity's shards."""
    runs = run_bitmap(df, entity, start, end, shard).withColumn("_part", F.floor(F.col("shard") / stretch))
    runs = staged(runs, "runs")
    reach = F.element_at("runs", -1)["e"]

    def beside(x: DataFrame, summary: DataFrame, *cols: str) -> DataFrame:
        y = summary.select(F.col("entity").alias("_e"), F.col("_part").alias("_p"), *cols)
        return x.join(y, x["entity"].eqNullSafe(y["_e"]) & (x["_part"] == y["_p"])).drop("_e", "_p")

    before = lambda *by: by[0].rowsBetween(Window.unboundedPreceding, -1)
    parts, inside = Window.partitionBy("entity"), Window.partitionBy("entity", "_part")
    ends = runs.groupBy("entity", "_part").agg(F.max(reach).alias("_reach"))
    ends = ends.select("entity", "_part", F.max("_reach").over(before(parts.orderBy("_part"))).alias("_earlier"), F.max("_reach").over(parts).alias("_last"))
    x = beside(runs, ends, "_earlier", "_last")
    x = x.withColumn("_before", F.greatest("_earlier", F.max(reach).over(before(inside.orderBy("shard")))))
    x = x.withColumn("_new", F.expr("filter(runs, r -> _before is null or r.s > _before)"))
    # the furthest end before the first new run: of earlier shards, or of this shard's runs that go on from them
    x = x.withColumn("_carry", F.expr("greatest(_before, array_max(transform(filter(runs, r -> r.s <= _before), r -> r.e)))"))
    x = staged(x.where(F.size("_new") > 0).select("entity", "_part", "shard", "_last", "_new", "_carry"), "new-runs")
    # the last period that begins in a shard ends where the next shard that begins one finds the furthest end
    first = x.groupBy("entity", "_part").agg(F.min_by("_carry", "shard").alias("_first"))
    first = first.select("entity", "_part", F.last("_first").over(before(parts.orderBy(F.desc("_part")))).alias("_later"))
    x = beside(x, first, "_later")
    x = x.withColumn("_end", F.coalesce(F.last("_carry").over(before(inside.orderBy(F.desc("shard")))), "_later", "_last"))
    out = F.expr(
        """flatten(transform(_new, (r, i) -> filter(array(
             named_struct('kind', 'period', 'start', r.s, 'end', case when i = size(_new) - 1 then _end else r.e end),
             named_struct('kind', 'gap', 'start', case when i = 0 then _carry else _new[i - 1].e end, 'end', r.s)),
             g -> g.start is not null)))"""
    )
    return x.select("entity", F.inline(out))


#: Ticks of the finest time bin of a range join, how many bins an interval may fill before it goes to the next level, and
#: how many levels there are.
BIN, FILL, LEVELS = 30_000, 64, 4


def _binned(df: DataFrame, side: str, start: str, end: str) -> DataFrame:
    """Rows of df for every time bin that an interval touches, at its own level and at all above."""
    length = F.col(end) - F.col(start)
    level = F.lit(0)
    for k in range(1, LEVELS):
        level = F.when(length > BIN * FILL**k, k).otherwise(level)

    def at(k: int) -> Column:
        size = BIN * FILL**k
        touched = F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))
        return F.when(level <= k, F.transform(touched, lambda b: F.struct(F.lit(k).alias("_level"), b.alias("_bin")))).otherwise(F.array())

    bins = [at(k) for k in range(LEVELS)]
    return df.where(F.col(end) > F.col(start)).select("*", level.alias(f"_own_{side}"), F.inline(F.concat(*bins)))


def overlapping(a: DataFrame, b: DataFrame, entity: str, a_times: tuple[str, str], b_times: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a and b of one entity whose half-open intervals overlap, with the overlap in ticks.

    The join is on entity, level and time bin, so a hot entity is spread by time; a pair is met at the level of the longer
    interval and in the one bin where the later of the two begins. Column names of a and b, but for entity, must differ."""
    x, y = _binned(a, "a", *a_times), _binned(b, "b", *b_times)
    later = F.greatest(F.col(a_times[0]), F.col(b_times[0]))
    size = F.lit(BIN) * F.pow(F.lit(FILL), F.col("_level"))
    j = x.join(y, [entity, "_level", "_bin"]).where(
        (F.col(a_times[0]) < F.col(b_times[1])) & (F.col(b_times[0]) < F.col(a_times[1])) & (F.greatest("_own_a", "_own_b") == F.col("_level")) & (F.floor(later / size) == F.col("_bin"))
    )
    return j.withColumn("overlap", F.least(F.col(a_times[1]), F.col(b_times[1])) - later).drop("_level", "_bin", "_own_a", "_own_b")


def attribute(segments: DataFrame, turns: DataFrame, entity: str, key: str, seg_times: tuple[str, str], turn_times: tuple[str, str], label: str, none: str = "UNKNOWN") -> DataFrame:
    """(key, label): the label whose turns overlap a segment longest; the first label on a tie, `none` without overlap."""
    o = overlapping(segments.select(entity, key, *seg_times), turns.select(entity, label, *turn_times), entity, seg_times, turn_times)
    best = o.groupBy(key, label).agg(F.sum("overlap").alias("_n")).groupBy(key).agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias(label))
    return segments.select(key).join(best, key, "left").select(key, F.coalesce(label, F.lit(none)).alias(label))


def multiplicity(segments: DataFrame, turns: DataFrame, entity: str, key: str, seg_times: tuple[str, str], turn_times: tuple[str, str], step: int, at_least: int = 2) -> DataFrame:
    """(key, samples, share): of the instants start, start + step, ... before a segment's end, the share at which at
    least so many turns are running (from their start to before their end). Segments without length have no row.

    Instants are counted from the overlaps: a turn covers the instants between two tick numbers, and a segment has no more
    of those than its length allows; nothing is joined instant by instant."""
    s0, s1, t0, t1 = *seg_times, *turn_times
    o = overlapping(segments.select(entity, key, s0, s1), turns.select(entity, t0, t1), entity, seg_times, turn_times)
    first = F.ceil(F.greatest(F.col(t0) - F.col(s0), F.lit(0)) / step)
    last = F.ceil((F.least(t1, s1) - F.col(s0)) / step)  # exclusive
    # every turn adds one from its first instant and takes it off after its last
    edges = o.select(key, F.inline(F.array(F.struct(first.alias("at"), F.lit(1).alias("d")), F.struct(last.alias("at"), F.lit(-1).alias("d"))))).groupBy(key, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("at")
    runs = edges.select(key, "at", F.sum("d").over(w).alias("n"), F.lead("at").over(w).alias("to"))
    hits = runs.where(F.col("n") >= at_least).groupBy(key).agg(F.sum(F.col("to") - F.col("at")).alias("hits"))
    samples = F.ceil((F.col(s1) - F.col(s0)) / step)
    j = segments.where(F.col(s1) > F.col(s0)).select(key, samples.alias("samples")).join(hits, key, "left")
    return j.select(key, "samples", (F.coalesce("hits", F.lit(0)) / F.col("samples")).alias("share"))
