"""Problem 2: splits that keep the records of one speaker together.

Records are tied by a graph of entity names. Its components are found by breadth-first search from many seeds at once:
every node whose hash is lower than its neighbours' is a seed, all frontiers advance by one edge a round over adjacency
rows hash-partitioned by node, and a node reached by several frontiers takes the label with the lowest hash. Edges
between differently labelled nodes are the collisions; they form a smaller graph of labels, whose components are found
in the same way and merge the labels. Each level has at most half the nodes that have edges, and nothing but row counts
reaches the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.functions.keys import speaker_key
from mundspark.operators.prefix import running_before, uniform
from mundspark.runtime import staged


def _rank(c: Column | str) -> Column:
    """Order of nodes: by hash, then by name."""
    c = F.col(c) if isinstance(c, str) else c
    return F.struct(F.xxhash64(c).alias("h"), c.alias("n"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected graph given by its edges; component is one of its nodes.
    Repeated edges and loops change nothing, edges with a NULL end are no edges, no edges give no rows."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    adjacent = staged(both.distinct(), "adjacency")
    lowest = adjacent.groupBy("a").agg(F.min(_rank("b")).alias("m"))
    seeds = lowest.where(_rank("a") < F.col("m")).select(F.col("a").alias("node"), F.col("a").alias("label"))
    frontier = staged(seeds, "frontier")
    if frontier.isEmpty():
        return frontier.select("node", F.col("label").alias("component"))
    reached = frontier
    while True:
        step = adjacent.join(frontier.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        fresh = step.join(reached.select("node"), "node", "left_anti").groupBy("node").agg(F.min(_rank("label")).alias("l"))
        frontier = staged(fresh.select("node", F.col("l.n").alias("label")), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    reached = staged(reached, "labels")
    la, lb = (reached.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    crossing = adjacent.where("a < b").join(la, "a").join(lb, "b").where("la <> lb").select("la", "lb").distinct()
    crossing = staged(crossing, "collisions")
    if crossing.isEmpty():
        return reached.select("node", F.col("label").alias("component"))
    merged = components(crossing, "la", "lb").select(F.col("node").alias("label"), "component")
    return reached.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def speaker_components(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(client_id, component): the spellings of one speaker share a component. One row for each non-empty spelling.

    Spellings are tied to the digits they carry (functions.keys.speaker_key); a spelling alone with its digits has no
    edge and is its own component."""
    names = df.select(F.col(client).alias("client_id")).where("client_id is not null and trim(client_id) <> ''").distinct()
    keyed = names.select("client_id", speaker_key(F.col("client_id")).alias("k")).where("k is not null")
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    # the hub of a speaker is a node of its own, told from spellings by a control character
    edges = staged(keyed.join(shared, "k").select("client_id", F.concat(F.lit("\u0001"), "k").alias("hub")), "spellings")
    found = components(edges, "client_id", "hub").where(~F.col("node").startswith("\u0001"))
    return names.join(found.withColumnRenamed("node", "client_id"), "client_id", "left").select("client_id", F.coalesce("component", "client_id").alias("component"))


def same_speaker_pairs(df: DataFrame, client: str = "client_id") -> DataFrame:
    """(client_id_a, client_id_b): different spellings of one speaker, the smaller first by code point. Their components
    come from speaker_components; that both carry the same digits is checked again."""
    c = speaker_components(df, client).withColumn("k", speaker_key(F.col("client_id")))
    many = staged(c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"), "component"), "speakers")
    a, b = (many.select("component", F.col("client_id").alias(f"client_id_{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
    hex16 = F.col("ka").rlike("^[0-9a-f]{16}$")
    return a.join(b, "component").where((F.col("client_id_a") < F.col("client_id_b")) & (F.col("ka") == F.col("kb")) & hex16).select("client_id_a", "client_id_b")


def grouped_split(df: DataFrame, key: str, client: str, strata: dict[str, Column], shares: dict[str, float], seed: int = 7) -> DataFrame:
    """(key, split, component): every row of df in one of the splits, all rows of a speaker in the same.

    Components go by their most frequent stratum (ties: the lower one). In each stratum, large components, with more rows
    than half of the smallest split's share, are placed one by one, the largest first, each in the split that is furthest
    behind its share (the largest quotient of wanted rows by rows so far and half of its own; ties: the split named first).
    There are no more of them than 2 / the smallest share. The others are taken in hash order, and the running row count
    before a component tells its split, by what the large ones have left to each. A row without a speaker is a component
    of its own. Strata may be NULL."""
    order = list(shares)
    names = list(strata)
    rows = df.select(F.col(key).alias("key"), F.col(client).alias("client_id"), *[c.alias(n) for n, c in strata.items()])
    ids = staged(speaker_components(df, client), "components")
    unit = F.coalesce("component", F.concat(F.lit("\u0002"), F.col("key").cast("string")))
    rows = rows.join(ids, "client_id", "left").withColumn("unit", unit)
    cells = rows.groupBy("unit", *names).agg(F.count(F.lit(1)).alias("n"))
    cell = F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])
    units = cells.groupBy("unit").agg(F.min_by(cell, F.struct(-F.col("n"), cell)).alias("stratum"), F.sum("n").alias("n"))
    units = staged(units.select("unit", "n", F.concat_ws("\u0001", "stratum.*").alias("stratum"), uniform("unit", seed=seed).alias("u")), "units")
    total = units.groupBy("stratum").agg(F.sum("n").alias("total"))
    units = units.join(total, "stratum")
    is_large = F.col("n") > F.col("total") * (min(shares.values()) / 2)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        total, have, out = float(pdf["total"].iloc[0]), dict.fromkeys(order, 0.0), []
        for r in pdf.sort_values(["n", "u", "unit"], ascending=[False, True, True]).itertuples():
            best = max(order, key=lambda x: (shares[x] * total / (have[x] + r.n / 2), -order.index(x)))
            have[best] += r.n
            out.append((r.unit, best, r.stratum, r.n))
        return pd.DataFrame(out, columns=["unit", "split", "stratum", "n"])

    large = staged(units.where(is_large).groupBy("stratum").applyInPandas(place, "unit string, split string, stratum string, n long"), "large-components")
    taken = large.groupBy("stratum").agg(*[F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)).alias(f"_t{i}") for i, x in enumerate(order)])
    placed = running_before(units.where(~is_large), ["stratum"], "u", "unit", "n", "before").join(taken, "stratum", "left")
    left = [F.greatest(F.col("total") * shares[x] - F.coalesce(f"_t{i}", F.lit(0)), F.lit(0.0)) for i, x in enumerate(order)]
    small = F.col("total") - sum((F.coalesce(f"_t{i}", F.lit(0)) for i in range(len(order))), F.lit(0))
    middle = (F.col("before") + F.col("n") / 2) / small * sum(left, F.lit(0.0))
    choice, upto = F.lit(order[0]), sum(left[1:], F.lit(0.0))
    for i in range(len(order) - 1, 0, -1):
        choice = F.when(middle <= upto, order[i]).otherwise(choice)
        upto = upto - left[i]
    split = placed.select("unit", choice.alias("split")).unionByName(large.select("unit", "split"))
    return rows.join(split, "unit").select(F.col("key").alias(key), "split", F.col("unit").alias("component"))
