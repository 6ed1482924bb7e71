"""Containing texts against all pairs, and how few rows are shuffled for them."""

import random

from pyspark.sql import functions as F

from mundspark.operators import matching


def test_against_all_pairs(spark):
    r = random.Random(3)
    text = lambda least, most: "".join(r.choice("abä") for _ in range(r.randint(least, most)))
    b = [(k, text(1, 40)) for k in range(150)] + [(k, None) for k in range(150, 153)]
    a = [text(1, 5) for _ in range(30)] + [b[k][1][3:20] for k in range(60)] + ["x" + b[k][1] for k in range(60, 90)] + ["", None, "zzz", "z" * 80]
    want = {x: min((k for k, y in b if x and y and (x in y or y in x)), default=None) for x in a}
    got = matching.contains_join(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame(b, "o long, y string"), "x", "y", "o").collect()
    assert len(got) == len(a) and {r.x: r.o for r in got} == want and any(want.values())
    none = matching.contains_join(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([], "o long, y string"), "x", "y", "o")
    assert all(r.o is None for r in none.collect())


def test_only_texts_with_a_wanted_piece_go_on(spark, monkeypatch):
    """Of many long texts, those that hold none of the pieces looked for are left out before they are shuffled."""
    seen = []
    whole = matching._offering
    monkeypatch.setattr(matching, "_offering", lambda texts, *x: seen.append((texts, out := whole(texts, *x))) or out)
    b = spark.range(2000).select("id", F.concat(F.lit("a/common/folder/"), F.sha1(F.col("id").cast("string")), F.lit(".wav")).alias("y"))
    a = b.where("id < 20").select(F.substr("y", F.lit(20), F.lit(20)).alias("x"))
    got = matching.contains_join(a, b, "x", "y", "id").collect()
    assert sorted(r.id for r in got) == list(range(20))
    assert [texts.count() for texts, _ in seen] == [2000, 20] and seen[0][1].count() <= 40 and seen[1][1].count() == 0
