import numpy as np
import pytest
from pyspark.sql import functions as F

from mundspark.llm.mixing import Mixer
from mundspark.llm import mixing, sampling
from mundspark.llm.sampling import Sampler, category, rake, weighted_order


def test_rake():
    counts = np.array([100.0, 50.0, 10.0, 200.0])
    a, b = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    x = rake(counts, [a, b], [np.array([60.0, 60.0]), np.array([50.0, 70.0])])
    assert np.allclose([x[0] + x[1], x[2] + x[3]], [60, 60]) and np.allclose([x[0] + x[2], x[1] + x[3]], [50, 70], atol=1e-3)
    x = rake(counts, [a], [np.array([500.0, 30.0])])  # more than there is
    assert np.allclose([x[0] + x[1], x[2] + x[3]], [150, 30]) and (x <= counts + 1e-9).all()
    assert rake(np.zeros(2), [np.array([0, 1])], [np.array([0.0, 0.0])]).sum() == 0


def test_rake_keeps_every_cell():
    counts = np.array([1000.0, 10000, 10, 20, 1000, 50])
    c, m = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 1, 0, 1, 0, 1])
    wanted = np.array([1208.0, 30, 1050])  # all that the second and the third group have
    x = rake(counts, [c, m], [wanted, np.bincount(m, counts) / counts.sum() * wanted.sum()])
    assert (x > 0).all() and (x <= counts).all() and np.allclose(np.bincount(c, x), wanted) and np.allclose(x[2:], counts[2:])


def test_short_categories_are_drawn_whole(spark):
    cells = {(0, "a"): 100, (0, "b"): 1000, (1, "a"): 1, (1, "b"): 2, (2, "a"): 100, (2, "b"): 5}
    rows = [(f"{c}{m}{i}", c, None, m) for (c, m), n in cells.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label_id int, dialect_region string, dataset string")
    t = spark.createDataFrame([("t", 0.3, c, 1 / 3, 0) for c in range(3)], "target_set string, sample_share double, label_id int, target_share double, min_rows int")
    r = {x.label_id: (x.drawn, x.available, x.short) for x in Sampler(df, t, "id", category(), ["dataset"]).report().collect()}
    assert r == {0: (121, 1100, False), 1: (3, 3, True), 2: (105, 105, True)}


def test_sampler(spark):
    rows = [(i, i % 3 if i % 7 else None, "Basel" if i % 7 == 0 and i % 2 else None, "d" if i % 5 else None, "g") for i in range(3000)] + [(9000 + i, 4, None, "d", None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, label_id int, dialect_region string, dataset string, gender string").withColumn("order", F.lit(1)).withColumn("weight", F.lit(0))
    t = spark.createDataFrame([("a", 0.2, 0, 0.5, 3), ("a", 0.2, 1, 0.48, 3), ("a", 0.2, 4, 0.02, 3), ("b", 0.01, 4, 0.001, 4), ("b", 0.01, 8, 0.5, 2)], "target_set string, sample_share double, label_id int, target_share double, min_rows int")
    s = Sampler(df, t, "id", category(), ["dataset", "gender"])
    n = sum(1 for r in rows if r[1] is not None or r[2])
    rep = {(r.target_set, r.label_id): r for r in s.report().collect()}
    assert rep["a", 0].drawn == round(n * 0.2 * 0.5) and not rep["a", 0].short
    assert rep["a", 4].drawn == 5 and rep["a", 4].short
    assert rep["b", 4].drawn == 4 and not rep["b", 4].short  # raised to the minimum
    assert rep["b", 8].drawn == 0 and rep["b", 8].short and rep["b", 8].below_minimum
    d = s.draw().collect()
    assert len({(r.target_set, r.id) for r in d}) == len(d)
    # the other margins keep the population's shares
    sets = {r[0]: r[3] for r in rows}
    mine = [sets[r.id] for r in d if r.target_set == "a" and r.label_id != 4]
    assert abs(sum(x is None for x in mine) / len(mine) - 0.2) < 0.05
    e = Sampler(df.limit(0), t, "id", category(), ["dataset"])
    assert all(r.drawn == 0 for r in e.report().collect()) and e.draw().count() == 0


def test_mixer(spark):
    docs = [(i, "ein kurzer text hier " * (1 + i % 5), ("s1", "s2", "s3", None)[i % 4], "de" if i % 3 else None) for i in range(400)] + [(900, "", "s1", "de"), (901, None, "s1", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").withColumn("copies", F.lit(7)).withColumn("rate", F.lit(1.0))
    t = spark.createDataFrame([("m", 0.3, "s1", 0.5, 2), ("m", 0.3, "s2", 0.5, 1), ("big", 2.0, "s3", 0.6, 3), ("big", 2.0, "nowhere", 0.4, 3)], "mix_name string, size_share double, source string, weight double, max_repeat int")
    m = Mixer(df, t, "doc_id", "text", "source", F.col("lang"), F.lit("t"))
    rep = {(r.mix_name, r.source): r for r in m.report().collect()}
    for k in (("m", "s1"), ("m", "s2")):
        assert not rep[k].short and abs(rep[k].actual - rep[k].wanted) <= 30 and rep[k].most_copies <= rep[k].max_repeat
    assert rep["big", "s3"].short and rep["big", "s3"].actual == rep["big", "s3"].reachable
    assert rep["big", "nowhere"].short and rep["big", "nowhere"].actual == 0
    used = m.copies().collect()
    assert {r.doc_id for r in used}.isdisjoint({900, 901}) and len({(r.mix_name, r.doc_id) for r in used}) == len(used)
    e = Mixer(df.limit(0), t, "doc_id", "text", "source", F.col("lang"), F.lit("t"))
    assert e.copies().count() == 0 and e.report().count() == 4


def test_mixer_short_source_uses_every_document(spark):
    cells = {("a", "x"): 4, ("a", "y"): 10, ("b", "x"): 60, ("b", "y"): 200, ("c", "x"): 60, ("c", "y"): 10}
    docs = [(f"{s}{lang}{i}", "wort " * 5, s, lang) for (s, lang), n in cells.items() for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id string, text string, source string, lang string")
    t = spark.createDataFrame([("m", 0.5, "a", 0.48, 1), ("m", 0.5, "b", 0.02, 1), ("m", 0.5, "c", 0.49, 1)], "mix_name string, size_share double, source string, weight double, max_repeat int")
    r = {x.source: x for x in Mixer(df, t, "doc_id", "text", "source", F.col("lang"), F.lit("")).report().collect()}
    for s, n in (("a", 14), ("c", 70)):
        assert r[s].short and r[s].actual == r[s].reachable and r[s].documents == n
    assert not r["b"].short and r["b"].documents == 3


@pytest.mark.parametrize("repeat", [1, 3])
def test_mixer_repeats_small_sources(spark, repeat):
    df = spark.createDataFrame([(i, "wort " * 10, "small" if i < 10 else "rest", "de") for i in range(100)], "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("m", 0.25, "small", 1.0, repeat)], "mix_name string, size_share double, source string, weight double, max_repeat int")
    r = Mixer(df, t, "doc_id", "text", "source", F.col("lang"), F.lit("")).report().first()
    assert (r.short, r.most_copies) == ((True, 1) if repeat == 1 else (False, 3))
    if repeat == 3:
        assert abs(r.actual / r.wanted - 1) < 0.1


def test_short_comes_from_what_is_drawn(spark, monkeypatch):
    """A draw that takes nothing changes which sources and categories fall short."""
    df = spark.createDataFrame([(i, "wort " * 10, "small" if i < 10 else "rest", "de") for i in range(100)], "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("m", 0.5, "small", 0.9, 1), ("m", 0.5, "rest", 0.1, 1)], "mix_name string, size_share double, source string, weight double, max_repeat int")
    m = Mixer(df, t, "doc_id", "text", "source", F.col("lang"), F.lit(""))
    assert {r.source: r.short for r in m.report().collect()} == {"small": True, "rest": False}
    drawn = m._drawn()
    monkeypatch.setattr(m, "_drawn", lambda: drawn.where("source <> 'small' or key % 2 = 0" if "key" in drawn.columns else "source <> 'small' or doc_id % 2 = 0"))
    assert {r.source: r.short for r in m.report().collect()} == {"small": False, "rest": False}
    rows = spark.createDataFrame([(i, i % 2, None) for i in range(100)], "id long, label_id int, dialect_region string")
    q = spark.createDataFrame([("a", 1.0, 0, 0.8, 0)], "target_set string, sample_share double, label_id int, target_share double, min_rows int")
    s = Sampler(rows, q, "id", category(), [])
    assert s.report().first().short
    drawn = s.draw()
    monkeypatch.setattr(s, "draw", lambda: drawn.where("id > 50"))
    assert not s.report().first().short


def test_keys_of_small_weights_stay_apart(spark):
    u = spark.range(2000).select((F.col("id") / 2000).alias("u"))
    for w in (1e-9, 0.01, 1.0, 50.0):
        keys = [r[0] for r in u.select("u", weighted_order(F.col("u"), F.lit(w)).alias("k")).orderBy("u").select("k").collect()]
        assert all(0 <= a < b < 1 for a, b in zip(keys[1:], keys[2:]))


def test_rare_margin_values_are_raked_together(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MARGIN", 3)
    rows = spark.createDataFrame([(i, i % 2, None, f"d{i % 50}") for i in range(1000)], "id long, label_id int, dialect_region string, dataset string")
    q = spark.createDataFrame([("a", 0.2, x, 0.5, 0) for x in (0, 1)], "target_set string, sample_share double, label_id int, target_share double, min_rows int")
    s = Sampler(rows, q, "id", category(), ["dataset"])
    assert s.cells.count() <= 8 and s.draw().count() == 200
    assert mixing.folded is sampling.folded
