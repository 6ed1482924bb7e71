import random

import numpy as np
import pytest

from mundspark.functions.text import fold, same_words
from mundspark.llm import overlap
from mundspark.llm.overlap import SuffixArray, cross_split_pairs, span_coverage

SCHEMA = "utt_id long, sentence string, client_id string, audio_path string, dataset string"
H = "0123456789abcdef"


def pairs(spark, train, ev):
    t, e = (spark.createDataFrame(x, SCHEMA) for x in (train, ev))
    return sorted(tuple(r) for r in cross_split_pairs(t, e).collect())


def test_cases(spark):
    s = "Die Hebamme prüft sofort die Käselaibe hinter der Mühle um 7 Uhr."
    train = [(1, s, H, "/a/X.mp3", "d"), (2, s, H, None, "d"), (3, s, "fedcba9876543210", None, "d"), (4, None, H, "/a/y.mp3", "d"), (5, "Ja.", H, None, "d"), (6, "nan", H, "", None)]
    ev = [
        (11, "«die hebamme PRUEFT sofort  die Kaeselaibe, hinter der Mu\u0308hle um 7 Uhr»", "spk_" + H.upper(), None, "e"),
        (12, s.replace("7", "8"), H, None, "e"), (13, "ganz anders", H, "D:\\b\\x.WAV", "d"), (14, "ganz anders", H, "/b/x.wav", "other"),
        (15, s.replace("Hebamme", "Hbamme").replace("Mühle", "Müühle"), H, None, "e"), (16, s.replace("Hebamme", "Apothekerin"), H, None, "e"),
        (17, None, H, None, None), (18, "ja", H, None, "e"), (19, "nan", H, "nan", "d"), (20, s, None, None, "d"), (21, s, "", "/b/Y.ogg", "d"),
    ]
    got = pairs(spark, train, ev)
    assert got == sorted([(1, 11), (2, 11), (1, 13), (1, 15), (2, 15), (5, 18), (4, 21)])


def test_empty_tables_and_clashing_columns(spark):
    assert pairs(spark, [], []) == []
    t = spark.createDataFrame([(1, "eins zwei drei", H, None, None, 1, 2, "x", 3)], SCHEMA + ", side int, class int, text string, prefix int")
    e = spark.createDataFrame([(2, "eins zwei drei", H, None, None, 1, 2, "x", 3)], SCHEMA + ", side int, class int, text string, prefix int")
    assert cross_split_pairs(t, e).count() == 1


@pytest.mark.parametrize("texts,limit", [(50_000, 64), (40, 1)])
def test_against_brute_force(spark, monkeypatch, texts, limit):
    """Also with speakers split into bins and runs passed on to spelled keys."""
    monkeypatch.setattr(overlap, "TEXTS", texts)
    monkeypatch.setattr(overlap, "PAIRS", limit)
    monkeypatch.setattr(overlap, "FREE", 12 if limit > 1 else 4)
    rnd = random.Random(4)
    words = "der die das boot zaun hund katze sofort gerne heute morgen prüft öffnet zählt mühle brücke 1 2 33 uhr im am".split()

    def typo(s):
        if not s:
            return s
        i = rnd.randrange(len(s))
        return s if not s[i].isalpha() else rnd.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + "x" + s[i + 1 :]])

    said = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))) for _ in range(150)]
    make = lambda first: [(first + i, (lambda s: typo(typo(s)) if rnd.random() < 0.5 else s)(rnd.choice(said)), rnd.choice([H, "a" * 16]), None, "d") for i in range(300)]
    train, ev = make(0), make(1000)
    want = sorted((a[0], b[0]) for a in train for b in ev if a[2] == b[2] and fold(a[1]) and fold(b[1]) and same_words(fold(a[1]), fold(b[1]), 2))
    assert pairs(spark, train, ev) == want
    # one and two words, long ones among them
    alphabet = "abcdeäöü"
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 5, 9, 45, 46, 90])))
    said = [" ".join(word() for _ in range(rnd.randint(1, 2))) for _ in range(120)]
    train, ev = make(0), make(1000)
    want = sorted((a[0], b[0]) for a in train for b in ev if a[2] == b[2] and fold(a[1]) and fold(b[1]) and same_words(fold(a[1]), fold(b[1]), 2))
    assert pairs(spark, train, ev) == want
    # a very long sentence, and copies of it
    long = " ".join(rnd.choice(words) for _ in range(3000))
    assert pairs(spark, [(1, long, H, None, "d"), (2, long, H, None, "d")], [(3, long.replace("hund", "hunnd", 1), H, None, "d")]) == [(1, 3), (2, 3)]


def test_suffix_array_is_sorted():
    rnd = random.Random(3)
    texts = [[rnd.randrange(4) for _ in range(rnd.randint(1, 9))] for _ in range(60)]
    group = np.array(sorted(rnd.randrange(3) for _ in texts))
    codes, offsets = np.array([w for t in texts for w in t]), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sa = SuffixArray(codes, offsets, group, 16, False)
    order, common = sa.sorted(np.flatnonzero(sa.place < np.diff(offsets)[sa.text]))
    suffixes = [(int(group[sa.text[x]]), texts[sa.text[x]][sa.place[x] :]) for x in order]
    assert sorted(map(str, suffixes)) == sorted(str((int(group[t]), texts[t][p:])) for t in range(len(texts)) for p in range(len(texts[t])))

    def shared(a, b):
        n = 0
        while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
            n += 1
        return n

    for a, b, c in zip(suffixes, suffixes[1:], common[1:]):
        n = shared(a, b)
        assert n == c
        if a[0] == b[0] and n < min(len(a[1]), len(b[1])):
            assert a[1][n] < b[1][n]
        else:
            assert a[0] <= b[0]


def test_sentences_of_one_pattern_are_not_all_paired(spark, monkeypatch):
    """Candidates of 400 sentences a split that differ in one word each grow with the texts, not with their pairs."""
    checked = []
    monkeypatch.setattr(overlap, "same_words", lambda a, b, n: checked.append(1) or same_words(a, b, n))
    made = random.Random(1)
    words = sorted({"".join(made.choice("bcdfgklmnprst") + made.choice("aeiou") for _ in range(5)) for _ in range(1200)})[:800]
    train = [(i, f"sag {w} noch einmal bitte", H, None, "d") for i, w in enumerate(words[:400])]
    ev = [(1000 + i, f"sag {w} noch einmal bitte", H, None, "d") for i, w in enumerate(words[400:])] + [(2000, f"sag {words[7]}x noch einmal bitte", H, None, "d")]
    t, e = (spark.createDataFrame(x, SCHEMA) for x in (train, ev))
    r = overlap._both(t, e)
    found = overlap.suffix_arrays(r.select("speaker", "class", "side", "text"), overlap._pairs_of, overlap._FOUND, 2, True)
    members = found.where("kind = 1").selectExpr("a as bucket", "speaker", "b as class", "side", "text", "free")
    keys = members.mapInArrow(overlap._spelled, "key long, speaker long, class long, side int")
    assert found.where("kind = 0").count() == 0 and members.count() > 800
    assert overlap._sides(keys, "key").distinct().count() < 4 * 801
    want = sorted((a[0], b[0]) for a in train for b in ev if same_words(fold(a[1]), fold(b[1]), 2))
    assert (7, 2000) in want and pairs(spark, train, ev) == want


def test_method_gives_the_rows(spark, monkeypatch):
    """Without common prefixes in the array there are no pairs of different texts."""
    s = "die hebamme prüft sofort die käselaibe hinter der mühle"
    train, ev = [(1, s, H, None, "d")], [(2, s.replace("sofort", "soffort"), H, None, "d")]
    assert pairs(spark, train, ev) == [(1, 2)]
    block = overlap.pa.table({"speaker": [1, 1], "bin": [0, 0], "bins": [1, 1], "class": [5, 6], "side": [1, 2], "main": [True, True], "text": [fold(train[0][1]), fold(ev[0][1])]})
    assert overlap._pairs_of(overlap._Block(block)).column("b").to_pylist() == [6]
    monkeypatch.setattr(SuffixArray, "sorted", lambda self, starts: (starts, np.full(len(starts), -1)))
    assert overlap._pairs_of(overlap._Block(block)).num_rows == 0


@pytest.mark.parametrize("texts", [50_000, 1])
def test_coverage(spark, monkeypatch, texts):
    monkeypatch.setattr(overlap, "TEXTS", texts)
    train = [(1, "a b c d e f", H, None, None), (2, "x y z u v", H, None, None), (3, "k l m n o", "f" * 16, None, None), (9, None, None, None, None), (4, "vier worte sind da", H, None, None)]
    ev = [(11, "q A b, c d e f q x y z u v", H, None, None), (12, "k l m n o", H, None, None), (13, "a b c d", H, None, None), (14, "a b c d e", None, None, None), (15, "Vier Worte sind da!", H, None, None), (16, "b d", H, None, None), (17, "z", H, None, None)]
    t, e = (spark.createDataFrame(x, SCHEMA) for x in (train, ev))
    assert sorted(tuple(r) for r in span_coverage(t, e).collect()) == [(11, 13, 11), (13, 4, 4), (15, 4, 4), (17, 1, 1)]
    assert span_coverage(t.limit(0), e).count() == 0
