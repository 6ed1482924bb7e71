import math

import pytest
from pyspark.sql import functions as F

from mundspark.functions import columns as C
from mundspark.functions.keys import file_key, speaker_key
from mundspark.functions.normalise import for_synthesis, run_key, words_only
from mundspark.functions.regions import region_label
from mundspark.functions.text import distance, fold, fold_array, same_words
from mundspark.operators import errors, features, metrics, reports, rows, transcript
from mundspark.operators.intervals import attribute, multiplicity, periods_and_gaps
from mundspark.operators.matching import contains_join, contains_or_id_join
from mundspark.operators.prefix import first_n, running_before
from mundspark.schemas import conform, require


def ask(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_keys(spark):
    ids = ["0123456789abcdef", "{0123456789ABCDEF}", "de-set:0123456789abcdef", "spk_0123-4567-89ab-cdef ", "x/0123456789ABCDEF", "Anna", " ", None, "nan"]
    assert ask(spark, ids, "string", speaker_key) == ["0123456789abcdef"] * 5 + ["anna", None, None, None]
    paths = ["/a/b/X.MP3", "D:\\k\\x.flac", "x", "", None, "nan", "/a/b.c/x.y.wav"]
    assert ask(spark, paths, "string", file_key) == ["x", "x", "x", None, None, None, "x.y"]
    assert ask(spark, ["Bâle", " GRAUBU\u0308NDEN", "Ost-Schweiz", "zuerich", "Paris", None], "string", region_label) == [0, 6, 3, 5, None, None]


def test_predicates(spark):
    assert ask(spark, [None, "", "\u00a0", "nan", "NULL", "x"], "string", C.is_placeholder) == [True] * 5 + [False]
    assert ask(spark, ["1.5", "x", "NaN", "-3", None], "string", C.seconds) == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert ask(spark, ["+1.5", "a1", "", None, "."], "string", C.number_like) == [True, False, False, False, True]
    assert ask(spark, ["ʃ m", "a b c d", "1 2 3", "abc", "nan", None], "string", C.phoneme_like) == [True, True, False, False, False, False]
    assert ask(spark, ["[Musik]", "- Musik -.", "Musik hier", None], "string", C.is_music) == [True, True, False, False]
    assert ask(spark, ["Привет", "Grüezi", "日本", None], "string", C.has_foreign_script) == [True, False, True, False]
    assert ask(spark, ["Ja.", "Ja.»", "Ja", None], "string", C.ends_sentence) == [True, True, False, False]
    assert ask(spark, ["/a/ev/spk_1/x.wav", "/x.wav"], "string", C.speaker_folder) == ["ev/spk_1", None]
    assert ask(spark, ["h?d=local-files:a__b.wav", "/p/q.wav"], "string", C.url_client) == ["a/b", "q"]
    assert ask(spark, [[0.2, 0.5, 0.5], []], "array<double>", C.argmax) == [1, None]
    row = spark.createDataFrame([("0.9", None, None), (None, "German", None), (None, "x", "0.4"), (None, None, "nan")], "i string, n string, p string")
    assert [r[0] for r in row.select(C.is_german(F.col("i"), F.col("n"), F.col("p"), ("german",), ("dialect",))).collect()] == [0, 1, 0, -1]


def test_normalisers(spark):
    assert ask(spark, ["„Ja  Straße!“", None, "[ﬁn. ]", "Ja…", "»", "\u00a0 'ach so ?! '"], "string", run_key) == ["ja strasse", "", "fin", "ja", "", "ach so"]
    assert ask(spark, ["Musik.", "[(– MUSIK –)].", "Ｍusik", "Musik.]", "(", "Musik Musik"], "string", C.is_music) == [True, True, True, False, False, False]
    assert ask(spark, ["Ja! »", "Ja.\"\"", "?", "", "Ja .\u00a0"], "string", C.ends_sentence) == [True, False, True, False, True]
    assert ask(spark, ["Grüezi,  WOHL!", None], "string", words_only) == ["grüezi wohl", None]
    assert ask(spark, ["hallo…du: ja", "", "Ok - gut;", None], "string", for_synthesis) == ["Hallo, du, ja.", "You need to add some text for me to talk.", "Ok, gut,", None]


def test_fold_and_same_words():
    import pyarrow as pa

    texts = ["«Über — Straße!»", "U\u0308ber\u00a0 strasse", "ﬁn\u200bden 3.", "", None, "❄"]
    assert fold_array(pa.array(texts)).to_pylist()[:4] == [fold(t) for t in texts[:4]]
    assert fold(texts[0]) == fold(texts[1]) == "ueber strasse" and fold(texts[2]) == "finden 3" and fold(None) == ""
    assert distance("abc", "abxc", 2) == 1 and distance("abc", "xyz", 2) == 3 and distance("", "ab", 2) == 2 and distance("", "abc", 2) == 3
    assert same_words("die kaeselaibe", "die kxselaibe", 1)  # one mistyped umlaut
    assert not same_words("um 3 uhr", "um 4 uhr", 2) and not same_words("a b", "a b c", 2) and not same_words("der hund", "der katze", 2)


def test_periods(spark):
    iv = [("a", 0, 10), ("a", 10, 20), ("a", 5, 7), ("a", 30, 30), ("a", 40, 5), ("a", 50, 60), ("a", 50, 60), ("b", 65_530, 200_000), ("b", 199_000, 200_010), ("b", 262_144, 262_145), (None, 1, 2), ("n", None, 3), ("neg", -5, 3), ("long", 0, 10**12), ("long", 5, 6)]
    df = spark.createDataFrame(iv, "entity string, start long, end long").withColumn("kind", F.lit("clash"))
    got = sorted((r[0] or "", *r[1:]) for r in periods_and_gaps(df, "entity", "start", "end").collect())
    assert got == [
        ("", "period", 1, 2), ("a", "gap", 20, 50), ("a", "period", 0, 20), ("a", "period", 50, 60), ("b", "gap", 200_010, 262_144),
        ("b", "period", 65_530, 200_010), ("b", "period", 262_144, 262_145), ("long", "period", 0, 10**12), ("neg", "period", -5, 3),
    ]
    assert periods_and_gaps(df.limit(0), "entity", "start", "end").count() == 0


def test_periods_scan_over_stretches(spark, monkeypatch):
    import random

    from mundspark.operators import intervals

    rnd = random.Random(6)
    iv = [(None if i % 3 else "e", s, s + rnd.choice([1, 30, 500, 4000])) for i, s in enumerate(rnd.randint(0, 60_000) for _ in range(250))]
    df = spark.createDataFrame(iv, "entity string, start long, end long")
    whole = {tuple(r) for r in periods_and_gaps(df, "entity", "start", "end").collect()}
    assert whole == {tuple(r) for r in periods_and_gaps(df, "entity", "start", "end", shard=64, stretch=3).collect()} and len(whole) > 20


def test_periods_random(spark):
    import random

    rnd = random.Random(3)
    iv = [(e, s, s + rnd.choice([0, 1, 3, 40, 200])) for e in range(5) for s in (rnd.randint(-300, 3000) for _ in range(60))]
    df = spark.createDataFrame(iv, "entity int, start long, end long")
    got = {tuple(r) for r in periods_and_gaps(df, "entity", "start", "end", shard=64).collect()}
    want = set()
    for e in range(5):
        runs = []
        for _, s, t in sorted(x for x in iv if x[0] == e and x[2] > x[1]):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], t)
            else:
                runs.append([s, t])
        want |= {(e, "period", s, t) for s, t in runs} | {(e, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    assert got == want


def test_attribution_ties_and_none(spark):
    seg = spark.createDataFrame([("e", 1, 0, 1000), ("e", 2, 5000, 6000), ("e", 3, 100_000, 10_000_000), ("f", 4, 0, 10)], "e string, id int, s long, t long")
    turns = spark.createDataFrame([("e", 0, 500, "b"), ("e", 500, 1000, "a"), ("e", 6000, 7000, "c"), ("e", 9_999_000, 99_999_999, "d")], "e string, ts long, tt long, label string")
    got = {r.id: r.label for r in attribute(seg, turns, "e", "id", ("s", "t"), ("ts", "tt"), "label").collect()}
    assert got == {1: "a", 2: "UNKNOWN", 3: "d", 4: "UNKNOWN"}
    share = {r.id: (r.samples, r.share) for r in multiplicity(seg, turns, "e", "id", ("s", "t"), ("ts", "tt"), 100, 1).collect()}
    assert share[1] == (10, 1.0) and share[2] == (10, 0.0) and share[4] == (1, 0.0)


def test_prefix(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("o"), F.lit(1).alias("one"))
    quota = spark.createDataFrame([(0, 7), (1, 0), (2, 99999)], "g long, n int")
    got = first_n(df, ["g"], "o", "id", quota, "n").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 7, 2: 1666}
    best = sorted((r.o, r.id) for r in df.where("g = 0").collect())[:7]
    assert sorted((r.o, r.id) for r in first_n(df, ["g"], "o", "id", quota, "n").where("g = 0").collect()) == best
    run = sorted((r.g, r.o, r.id, r.before) for r in running_before(df, ["g"], "o", "id", "one", "before").collect())
    assert all(r[3] == i for g in range(3) for i, r in enumerate(x for x in run if x[0] == g))


def test_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 3, 1), (None, 4, 1)], "k string, i int, t int")
    assert {(r.k, r.i) for r in rows.first_row(df, ["k"], [F.col("i")]).collect()} == {("a", 1), ("b", 3), (None, 4)}
    assert {(r.k, r.i) for r in rows.last_row(df, ["k"], [F.col("t").isNull(), F.col("t")]).collect()} == {("a", 1), ("b", 3), (None, 4)}
    assert rows.sample_per_group(df, "k", "i", 1).count() == 2
    assert rows.holdout(df, "i", 0.1).where("is_eval").count() == 1 and rows.holdout(df.limit(0), "i", 0.1).count() == 0
    assert sorted(r.i for r in rows.unless_done(df, df.where("k = 'a'"), "k").collect()) == [3, 4]
    q = rows.fill_quotas([("x", df.where("k = 'a'"), df, 3), ("y", df, None, 5)], "i", [F.col("t").desc()])
    assert sorted(r.split for r in q.collect()) == ["x", "x", "x", "y"]


def test_reports(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), (None, 2)], "k string, s int").withColumn("split", F.lit("t"))
    assert reports.duplicate_keys(df, "k").collect()[0].n == 3
    assert reports.shared_keys(df, "k", "split").count() == 0
    a, b = df.select("k"), spark.createDataFrame([("y",)], "k string")
    assert {tuple(r) for r in reports.key_diff(a, b, "k").collect()} == {("x", "only_a"), ("y", "only_b")}
    m = reports.membership(a, {"b": b}, "k").collect()
    assert len(m) == 4 and not any(r.in_b for r in m)
    one, two = (reports.fingerprint(df.orderBy(F.col("s").desc() if d else F.col("s")), ["k", "s"]).first() for d in (0, 1))
    assert one == two and reports.fingerprint(df.limit(3), ["k", "s"]).first() != one


def test_transcript_rules(spark):
    seg = [("e", i, float(s), float(t), sp, x, 0.5) for i, (s, t, sp, x) in enumerate([(0, 1, "A", "eins"), (1.8, 2, "A", "zwei"), (2.9, 3, "A", "drei."), (3, 4, "A", "vier"), (4, 5, "B", "fünf"), (1300, 1301, "B", ""), (1301, 1302, "B", "acht")])]
    df = spark.createDataFrame(seg, "episode string, id int, start double, end double, speaker string, text string, overlap_coverage double")
    got = [(r.text, r.segments) for r in transcript.sentences(df, "episode", "id").orderBy("start").collect()]
    assert got == [("eins zwei", 2), ("drei.", 1), ("vier", 1), ("fünf", 1), ("acht", 2)]
    runs = [("e", i, float(i * 400), t) for i, t in enumerate(["Ja.", "ja", "JA!", "nein", "nein", "", "", "", "ja"])]
    d = spark.createDataFrame(runs, "episode string, id int, start double, text string")
    assert sorted(r.id for r in transcript.drop_runs(d, "episode", ["start", "id"]).collect()) == [3, 4, 5, 6, 7, 8]
    s = spark.createDataFrame([(1, "Ab. Cd!", 0.0, 7.0), (2, None, 0.0, 1.0)], "id int, text string, start double, end double")
    assert [(r.text, r.start, r.end) for r in transcript.split_sentences(s, ["id"], "text", "start", "end").orderBy("part").collect()] == [("Ab.", 0.0, 3.5), ("Cd!", 3.5, 7.0)]


def test_contains_join(spark):
    a = spark.createDataFrame([("clip_0001.wav",), ("zz",), ("/root/x/very/long/path/abc.wav",), ("none",), ("",)], "x string")
    b = spark.createDataFrame([(2, "/d/clip_0001.wav"), (1, "/e/clip_0001.wav.bak"), (3, "abc.wav"), (4, "azzb"), (5, "")], "o int, y string")
    got = {r.x: r.o for r in contains_join(a, b, "x", "y", "o").collect()}
    many = spark.createDataFrame([(i, f"common/folder/of/all/{i:04d}/clip.wav") for i in range(400)], "o int, y string")
    some = spark.createDataFrame([(f"of/all/{i:04d}/clip.wav",) for i in range(0, 400, 7)], "x string")
    assert all(r.x == f"of/all/{r.o:04d}/clip.wav" for r in contains_join(some, many, "x", "y", "o").collect())
    x, y = spark.createDataFrame([("/a/concat_7.wav",), ("/a/concat_8.wav",)], "x string"), spark.createDataFrame([(2, "/b/c/concat_7.flac"), (1, "/z/concat_7.mp3")], "o int, y string")
    assert {r.x: r.o for r in contains_or_id_join(x, y, "x", "y", "o").collect()} == {"/a/concat_7.wav": 1, "/a/concat_8.wav": None}
    assert got == {"clip_0001.wav": 1, "zz": 4, "/root/x/very/long/path/abc.wav": 3, "none": None, "": None}


#: Reference, hypothesis and their published word and character error rates, to four digits.
GOLDEN = [
    ("Es zieht hier ein wenig, schließen Sie bitte das Fenster.", "Es zieht hier ein wenig, schließt uns ein bisschen durchs Fenster.", 0.5, 0.2826),
    ("Vielen Dank für Ihre schnelle Rückmeldung.", "Vielen Dank für Ihre schnelle Rückmeldung.", 0.0, 0.0),
    ("Sie missverstehen meine Absicht vollkommen.", "Ich muss verstehen, dass meine Absicht vollkommen ist.", 1.0, 0.2895),
    ("Wir besprechen das Problem morgen ausführlich im Team.", "So viel sprechen das Problem morgen, das fühle ich in dem, der zäh.", 1.25, 0.3696),
]


def test_error_rates(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, _, _) in enumerate(GOLDEN)] + [(90, "", ""), (91, "", "x"), (92, None, None), (93, "a b", "")], "i int, r string, h string")
    got = {r.i: (round(r.wer, 4), round(r.cer, 4)) for r in errors.error_rates(df, "r", "h").collect()}
    assert {i: got[i] for i in range(len(GOLDEN))} == {i: (w, c) for i, (_, _, w, c) in enumerate(GOLDEN)}
    assert got[90] == (0, 0) and got[91] == (1, 1) and got[92] == (0, 0) and got[93] == (1, 1)
    same = spark.createDataFrame([("g", "the cat sat on the mat", "the cat sat on the mat")], "g string, r string, h string")
    assert abs(errors.bleu(same, "r", "h", "g").first().bleu - 100) < 1e-9 and abs(errors.chrf(same, "r", "h", "g").first().chrf - 100) < 1e-9
    part = spark.createDataFrame([("g", "the cat sat on the mat", "the cat the cat on")], "g string, r string, h string")
    b = errors.bleu(part, "r", "h", "g").first().bleu
    # 4 of 5, 1 of 4, then none of 3 and of 2 (halved each time), with the brevity of 5 for 6
    want = 100 * math.exp((math.log(4 / 5) + math.log(1 / 4) + math.log(1 / (2 * 3)) + math.log(1 / (4 * 2))) / 4 + 1 - 6 / 5)
    assert abs(b - want) < 1e-6


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0), (None, 1)], "t int, p int")
    cm = metrics.confusion(df, "t", "p")
    s = metrics.summary(cm).first()
    assert s.n == 5 and s.accuracy == 0.6
    c = {r.label: r for r in metrics.per_class(cm).collect()}
    assert c[2].recall == 0 and c[2].f1 == 0 and c[1].precision == 2 / 3
    n = {r.label: (r.correct, r.neighbour, r.other) for r in metrics.neighbour_table(cm).collect()}
    assert n == {0: (1, 1, 0), 1: (2, 0, 0), 2: (0, 0, 1)}
    v = spark.createDataFrame([("s", "x", 1), ("s", "y", 0), ("s", None, 2)], "k string, v string, o int")
    assert metrics.majority(v, "k", "v", "o").first().v == "y"
    f = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("b", float("nan"), 3)], "g string, s double, o int")
    assert {r.g: r.o for r in metrics.best_per(f, "g", "s", "o", ["o"]).collect()} == {"a": 1, "b": 3}


def test_bayes_against_formula(spark):
    docs = spark.createDataFrame([(1, "a b a", "x"), (2, "a c", "x"), (3, "b c c", "y"), (4, "z", None)], "doc int, text string, label string")
    counts = features.term_counts(docs, "doc", F.col("text"), (1,))
    nb = features.NaiveBayes.fit(counts, docs.select("doc", "label"), min_df=1)
    got = {(r.doc, k): r.s0[i] for r in features.scores([nb], counts, docs.select("doc")).collect() for i, k in enumerate(nb.labels)}
    tf = {"x": {"a": 3, "b": 1, "c": 1}, "y": {"b": 1, "c": 2}}
    prior = {"x": math.log(2 / 3), "y": math.log(1 / 3)}
    for d, text in ((1, "a b a"), (3, "b c c"), (4, "")):
        for k in "xy":
            want = prior[k] + sum(math.log((tf[k].get(w, 0) + 0.1) / (sum(tf[k].values()) + 0.3)) for w in text.split())
            assert abs(got[d, k] - want) < 1e-9
    assert {r.doc: r.label for r in nb.predict(counts, docs.select("doc")).collect()} == {1: "x", 2: "x", 3: "y", 4: "x"}


def test_term_arrays_are_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b a", 5), (2, "", 6), (3, None, 7), (4, "x", 8), (5, "c " * 300, 9)], "doc int, text string, k int")
    got = {(r.doc, r.k): sorted(t.tf for t in r.terms) for r in features.term_arrays(docs, "doc", F.col("text"), ("k",)).collect()}
    assert got == {(1, 5): [1, 1, 1, 2, 2, 2], (2, 6): [], (3, 7): [], (4, 8): [], (5, 9): [297, 298, 299]}
    long = {r.doc: r.n for r in features.term_counts(docs, "doc", F.col("text")).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert long == {d: len(v) for (d, _), v in got.items() if v}


def test_two_stage(spark):
    groups = spark.createDataFrame([("g",), ("h",), ("none",)], "group string")
    binary = spark.createDataFrame([("g", 0, 0.2), ("g", 1, 0.8), ("h", 0, 0.5), ("h", 1, 0.5)], "group string, label int, p double")
    fine = spark.createDataFrame([("g", 1, 1.0), ("h", 2, 0.5), ("h", 1, 0.5)], "group string, label int, p double")
    assert {r.group: (r.is_german, r.label_id) for r in features.two_stage(groups, binary, fine).collect()} == {"g": (1, 7), "h": (0, 1), "none": (1, 7)}


def test_vectors(spark):
    assert ask(spark, [[1.0, 2.0, 3.0], []], "array<double>", lambda c: features.fixed_length(c, 2)) == [[1.0, 2.0], [0.0, 0.0]]
    assert ask(spark, [[1.0] * 5], "array<double>", lambda c: features.frames(c, 4, 2)) == [[[1.0] * 4]]
    assert ask(spark, [[3.0, 1.0], []], "array<double>", lambda c: features.pooled(c)["mean"]) == [2.0, None]


def test_conform(spark):
    df = spark.createDataFrame([("p", "x", "7")], "clip_path string, text string, label_id string")
    got = conform(df, "utterance").first()
    assert got.audio_path == "p" and got.sentence == "x" and got.label_id == 7 and got.canton is None
    with pytest.raises(ValueError, match="nope"):
        require(df, "nope")


def test_staged_tables_can_be_cleared(spark):
    from mundspark.runtime import clear, staged

    d = staged(spark.range(3).toDF("id"))
    assert d.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        d.count()


def test_width_follows_the_scans(spark, tmp_path):
    from mundspark.runtime import width

    spark.range(50_000).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert width(t) == least and width(t.join(t.withColumnRenamed("id", "j"), F.col("id") == F.col("j"))) == least
    assert width(t, size // 40) in range(40, 43) and width(spark.createDataFrame([(1,)], "i int")) == least
