import json
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from mundspark.sources import delimited, episodes, media, sinks, web


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strings_and_missing(spark, tmp_path):
    p = put(tmp_path / "a.tsv", 'path\tsentence\tcanton\nx\t"say ""hi"""\t zh \ny\t\tNA\n')
    rows = delimited.read_utterances(spark, p).orderBy("path").collect()
    assert [tuple(r) for r in rows] == [("x", 'say "hi"', "ZH"), ("y", "", "NA")]
    assert [r.canton for r in delimited.read_strings(spark, p, missing=True).orderBy("path").collect()] == [" zh ", None]
    assert delimited.read_columns(spark, p, ["canton", "other"]).columns == ["canton"]
    assert delimited.count_lines(spark, p) == 3


def test_sniff(spark, tmp_path):
    assert [delimited.sniff(x) for x in ("a,b,c", "a\tb", "a;b;c,d", "a|b|c", "a")] == [",", "\t", ";", "|", ","]
    p = put(tmp_path / "s.csv", "a;b\n1;2\n")
    assert delimited.read_sniffed(spark, p).collect()[0].asDict() == {"a": "1", "b": "2"}


def test_unquoted_keeps_short_rows_and_leaves_out_long(spark, tmp_path):
    a = put(tmp_path / "a.tsv", 'p\tq\n1\t"x\n2\n3\t4\t5\n')
    b = put(tmp_path / "b.tsv", "p\tq\n6\t7\n")
    assert sorted(map(tuple, delimited.read_unquoted(spark, [a, b]).collect()), key=str) == [("1", '"x'), ("2", None), ("6", "7")]


def test_ragged_harvest(spark, tmp_path):
    row = lambda n, ph: "\t".join(["c1", *["0"] * (n - 2), ph])
    lines = ["h", row(6, "a b"), row(7, "a b c"), row(11, "x"), row(9, "y"), "c2\tɪ m a", "c3\tplain", "c4\t" + "\t".join("0" * 4) + "\tnan"]
    p = put(tmp_path / "m.tsv", "\n".join(lines) + "\n")
    got = {r.clip_path: (r.phoneme, r["rank"]) for r in delimited.harvest_phonemes(spark, p).collect()}
    assert got == {"c1": ("x", 4), "c2": ("ɪ m a", 1)}
    patch = spark.createDataFrame([("c2", "q q"), ("c4", "z")], "clip_path string, phoneme string")
    got = {r.clip_path: r.phoneme for r in delimited.harvest_phonemes(spark, p, patch).collect()}
    assert got == {"c1": "x", "c2": "q q", "c4": "z"}
    assert [r.fields for r in delimited.inspect_lines(spark, p, 3, 2).orderBy("line").collect()] == [11, 9]


def test_lists_and_patterns(spark, tmp_path):
    p = put(tmp_path / "s.txt", "# note\n\nEins.\n Zwei. \n")
    assert [tuple(r) for r in delimited.read_sentences(spark, p).orderBy("sentence_id").collect()] == [("sentence_01", "Eins."), ("sentence_02", "Zwei.")]
    m = put(tmp_path / "meta.txt", "a.wav|hallo\n/x/b.wav\tdu\nbad\n")
    assert sorted(map(tuple, delimited.read_metadata(spark, m, "/r/").collect())) == [("/r/a.wav", "hallo"), ("/x/b.wav", "du")]
    assert delimited.pattern_counts(spark, [p], ["EI", "q"]).orderBy("pattern").collect()[0].hits == 2


def test_episodes_metrics_logs(spark, tmp_path):
    put(tmp_path / "e/x.json", json.dumps({"segments": [{"start": 1, "end": 2.5, "speaker": "S", "text": "t"}]}))
    put(tmp_path / "e/d/y.csv", "start,end,speaker,text\n3,4,S,u\n")
    got = {r.episode: (r.start, r.end, r.overlap_coverage) for r in episodes.read_episodes(spark, str(tmp_path / "e")).collect()}
    assert got == {"x": (1.0, 2.5, 0.0), "y": (3.0, 4.0, 0.0)}
    put(tmp_path / "m/r1/metrics.json", json.dumps({"acc": 0.75, "cm": [[2, 1], [0, 1]]}))
    put(tmp_path / "m/r2/metrics.json", json.dumps({"accuracy": 0.9, "confusion_matrix": [[1, 1], [0, 0]]}))
    m = episodes.read_metrics(spark, str(tmp_path / "m"))
    assert {r.run: r.accuracy for r in m.collect()} == {"r1": 0.75, "r2": 0.9}
    assert [r.run for r in episodes.accuracy_mismatch(m).collect()] == ["r2"]
    put(tmp_path / "t/run/trainer_state.json", json.dumps({"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval": 1}]}))
    assert [(r.run, r.step, r.loss) for r in episodes.read_trainer_log(spark, str(tmp_path / "t")).collect()] == [("run", 1, 0.5)]
    assert episodes.training_size(100, 4, 2, 3, 2)["steps"] == 10


def wav(path, seconds, rate=16000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        t = (np.sin(np.arange(int(seconds * rate)) / 20) * 9000).astype("<i2")
        w.writeframes(struct.pack(f"<{len(t)}h", *t))


def test_media(spark, tmp_path):
    wav(tmp_path / "a.wav", 0.5)
    (tmp_path / "b.wav").write_bytes(b"broken")
    d = {r.path.rsplit("/", 1)[1]: r.seconds for r in media.durations(spark, str(tmp_path)).collect()}
    assert d == {"a.wav": 0.5, "b.wav": None}
    files = media.discover(spark, str(tmp_path))
    assert files.count() == 2
    t = spark.createDataFrame([(str(tmp_path / "a.wav"),), ("/none.wav",)], "p string")
    assert media.existing(t, "p", files).count() == 1
    mel = media.mel_features(spark, str(tmp_path)).collect()
    assert len(mel) == 1 and len(mel[0].mel) == 128 * 400
    np.save(tmp_path / "f.npy", np.arange(6).reshape(3, 2))
    assert [r.vector for r in media.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]


def test_infer_halves_failing_batches(spark):
    def load():
        def model(items):
            if "bad" in items:
                raise MemoryError("no room")
            return ["" if x == "none" else x.upper() for x in items]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "none"), (4, "b")], "k int, v string")
    got = {r.k: (r.result, bool(r.reason)) for r in media.infer(df, "k", "v", load).collect()}
    assert got == {1: ("A", False), 2: ("NO_PHONEME", True), 3: ("NO_PHONEME", True), 4: ("B", False)}


def test_web(spark, tmp_path):
    p = put(tmp_path / "f.xml", "<rss><channel><title>c</title><item><title> A </title><link>l</link><enclosure url='e.mp3'/></item><item><title>B</title><link>m</link></item></channel></rss>")
    assert sorted((r.title, r.url) for r in web.read_feed(spark, p).collect()) == [("A", "e.mp3"), ("B", "m")]
    pages = spark.createDataFrame(
        [("http://h/s/my-show", "<title>t</title><h1>Head</h1><a href='/s/one'>x</a><a href='/s/one'>y</a><source src='a.mp3'>"), ("http://h/s/the-other/", "<a href='f.mp3'>"), ("http://h/n", None)],
        "url string, html string",
    )
    d = web.parse_pages(pages)
    assert {r.url: r.name for r in web.series_info(d).collect()} == {"http://h/s/my-show": "Head", "http://h/s/the-other/": "The Other", "http://h/n": "N"}
    assert sorted(r.audio_url for r in web.episode_audio(d, "p").collect()) == ["http://h/s/a.mp3", "http://h/s/the-other/f.mp3"]
    assert web.series_links(d, "/s/").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b', ["x", "y"], 0), (2, None, [], 1)], "i int, t string, l array<string>, lab int")
    sinks.write_delimited(df, str(tmp_path / "o"))
    assert sorted(map(tuple, delimited.read_strings(spark, str(tmp_path / "o")).collect())) == [("1", 'a"b', "x|y", "0"), ("2", "", "", "1")]
    sinks.append_manifest(df.select("i"), str(tmp_path / "m"))
    sinks.append_manifest(df.select("i"), str(tmp_path / "m"))
    assert delimited.read_strings(spark, str(tmp_path / "m"), ",").count() == 4
    sinks.write_by_label(df.select("i", "lab"), str(tmp_path / "lab"), "lab", [0, 1, 2])
    assert (tmp_path / "lab/lab=2").is_dir()
    sinks.tee(df.select("i", "t"), {str(tmp_path / "all"): None, str(tmp_path / "some"): "t is null"})
    assert delimited.read_strings(spark, str(tmp_path / "some")).count() == 1
    assert sinks.write_summary(df.agg(F.count("i").alias("n")), str(tmp_path / "s.json")) == {"n": 2}
    df.select("i").write.parquet(str(tmp_path / "p"))
    sinks.rewrite(spark, str(tmp_path / "p"), lambda d: d.where("i = 1"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.write_unquoted(spark.createDataFrame([("a\tb", "c\\d")], "x string, y string"), str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).first()[0] == "a\\\tb\tc\\\\d"
    seg = spark.createDataFrame([("e", 2.0, 3.0, "s", "b", 0.0), ("e", 1.0, 2.0, "s", "a", 0.0)], "ep string, start double, end double, speaker string, text string, overlap_coverage double")
    sinks.write_transcripts(seg, str(tmp_path / "tr"), "ep")
    assert [s.text for s in spark.read.json(str(tmp_path / "tr")).first().segments] == ["a", "b"]
