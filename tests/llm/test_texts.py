import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mundspark.llm import languages as L
from mundspark.llm.tokenize import PATTERN, VOCABULARY, Encoder, read_ranks, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary files are not here")


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(read_ranks(f.read()))


def test_same_ids_as_a_public_encoder(encoder):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    texts = ["", "aaaaaaaa", "Grüezi mitenand!", "x" * 5000, " " * 300, "ab" * 3000, "<|endoftext|>", "🎙️👏 日本語 \u200b\ufeff", "a\n\n b\r\n\tc", "ʃəɔœ" * 50]
    texts += ["".join(rnd.choice("abcdeäöü éèñ .,!?0123456789\n'sßxyz🎉") for _ in range(rnd.randint(1, 400))) for _ in range(200)]
    texts += ["".join(rnd.choice("ab") for _ in range(n)) for n in (10, 100, 4000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert b"".join(enc.decode_single_token_bytes(i) for i in ids).decode() == t


def test_token_table(spark):
    df = spark.createDataFrame([(1, "ja"), (2, ""), (3, None), (1, "ja")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted((r.doc_id, len(r.ids)) for r in token_ids(df, "doc_id", F.col("text")).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[2][1] == got[3][1] == 0
    n = {r.doc_id: r.n_tokens for r in token_ids(df, "doc_id", F.col("text"), counts=True).collect()}
    assert n[3] == 0 and n[1] == got[0][1]
    assert token_ids(df.limit(0), "doc_id", F.col("text")).count() == 0


SAMPLE = {
    "de": "Die Hebamme prüft sofort den alten Zaun. Im Februar öffnet der Uhrmacher gerne das Tagebuch. Wir haben die Pausen von Hand gemessen. Heute früh verkauft meine Schwester ein Boot.",
    "gsw": "D Hebamm prüeft grad de alti Zuun. Im Horner macht de Uhremacher s Tagebuech uf. Mir händ d Pause vo Hand gmässe. Hüt am Morge verchauft mini Schwöschter es Schiff.",
    "fr": "La sage-femme vérifie la vieille clôture. En février, l'horloger ouvre le journal intime. Nous avons mesuré les pauses à la main. Ce matin ma soeur vend un bateau.",
    "it": "La levatrice controlla il vecchio steccato. In febbraio l'orologiaio apre il diario. Abbiamo misurato a mano le pause. Questa mattina mia sorella vende una barca.",
    "en": "The midwife checks the old fence at once. In February the watchmaker opens the diary. We measured the pauses by hand. This morning my sister sells a boat.",
}


def docs(spark, extra):
    rows = [(i * 10 + k, SAMPLE[c], c) for i in range(12) for k, c in enumerate(SAMPLE)]
    rows += [(800 + i, SAMPLE["de"], "fr") for i in range(2)]  # wrong labels among those it is fitted on
    return spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("languages", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("u", F.lit(0.0))


def test_languages(spark):
    first = lambda c: SAMPLE[c].split(". ")[0] + "."
    extra = [
        (1001, SAMPLE["it"], None), (1002, SAMPLE["de"], "de_CH"), (1003, SAMPLE["gsw"], "de"), (1004, first("en") + " " + SAMPLE["de"], "de"), (1005, "«La Petite Heure» – " + SAMPLE["de"], "de"),
        (1006, None, None), (1007, "", None), (1008, "♪ ♪ 12:30 ...", "und"), (1009, "/d ə ʁ h ʊ n d l ɔ ɪ f t/", "zxx"), (1010, SAMPLE["fr"].upper(), "unknown"), (1011, "<p>" + SAMPLE["en"] + "</p>", "es"),
        (1012, " ".join([SAMPLE["fr"]] * 500), "fr"), (1013, "d ə ʁ h ʊ n d l ɔ ɪ f t", None),
    ]
    d = docs(spark, extra)
    got = sorted(tuple(r) for r in L.label_faults(d).collect() if r.doc_id > 1000)
    assert got == [(1001, "it"), (1003, "gsw"), (1004, "de"), (1004, "en"), (1010, "fr"), (1011, "en")]
    assert {r.doc_id for r in L.label_faults(d).collect() if r.doc_id < 1000} == {800, 801}
    each = {(r.doc_id, r.lang): r.confidence for r in L.document_languages(d).collect()}
    assert all(0.5 <= c <= 1 for c in each.values()) and (1012, "fr") in each and (1006, "de") not in each
    parts = [(r.part, r.lang) for r in L.mixed_parts(d).where("doc_id = 1004").orderBy("part").collect()]
    assert parts == [(0, "en"), (1, "de")]
    assert L.label_faults(d.limit(0)).count() == 0


def test_filter_counts_false_positives():
    import numpy as np

    f = L.LanguageFilter([np.arange(1, 50_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(0, np.uint64)])
    assert 0 < f.false[0] < 0.01 and f.false[1] == 0
    s = f.shares(["", "abc def"])
    assert s.shape == (2, 2) and (s[0] == 0).all()


def test_labels(spark):
    d = spark.createDataFrame([(x,) for x in ("DE", "de_CH", " Swiss German ", "français", "mul", "es", None, "")], "v string")
    assert [r[0] for r in d.select(L.language_of_label(F.col("v"))).collect()] == ["de", "de", "gsw", "fr", None, None, None, None]


def test_no_sentence_is_lost():
    """Short words, tables and long titles: what is left out is phonetic writing and quotations beside other words."""
    said = lambda t: [s for s, _, _ in L.sentences(t)]
    assert said("I am at it. We go to it.") == ["i am at it", "we go to it"] and said("Il a vu un os.") == ["il a vu un os"]
    assert said("| Die Zahlen | sind gut |") == ["die zahlen", "sind gut"]
    assert said("d ə ʁ f ɛ h ʁ m a n n ʁ aɪ n ɪ ɡ t") == [] and said("/ d ɪ ə /") == []
    assert said("Wir lasen «The Long Way to a Small and Very Angry Planet of the Far and Distant North» gern.") == ["wir lasen gern"]
    assert said("«ohne Ende und Punkt»") == ["ohne ende und punkt"] and said("Er sagt: «Wir kommen.»") == ["er sagt wir kommen"]


def test_short_sentences_may_add_a_language():
    shares = np.array([[0.9, 0.1, 0, 0, 0], [0, 0, 0.95, 0.1, 0], [0, 0.3, 0.5, 0, 0]])
    assert [x for x, _ in L.decide([("a b c d", 4, True), ("merci beaucoup", 2, True), ("e f", 2, True)], shares)[0]] == [0, 2]
    assert [x for x, _ in L.decide([("a b c d", 4, True), ("merci beaucoup", 2, False), ("e f", 2, True)], shares)[0]] == [0]
