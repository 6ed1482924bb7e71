"""Properties of the plain functions behind the operators."""

import unicodedata

from hypothesis import given
from hypothesis import strategies as st

from mundspark.functions.text import distance, fold, same_words
from mundspark.operators.chunks import walk
from mundspark.operators.errors import translation_edits

TEXT = st.text(alphabet="aäbcdeoöuü ßABÄ.,!?[](){}<>*:–-0123456789̈ ​♪", max_size=60)
SIZES = st.lists(st.floats(0, 50, allow_nan=False), max_size=40)


@given(SIZES, st.floats(0.5, 60))
def test_chunks_partition_the_items(sizes, target):
    begun, _ = walk(sizes, target, "pre")
    assert all(0 <= b - a <= 1 for a, b in zip([0, *begun], begun))
    for c in set(begun):
        part = [d for d, b in zip(sizes, begun) if b == c]
        total = 0.0
        for d in part:
            total += d
        assert len(part) == 1 or total <= target
        after = [d for d, b in zip(sizes, begun) if b == c + 1]
        assert not after or total + after[0] > target


@given(st.text(alphabet="abcä", max_size=8), st.text(alphabet="abcä", max_size=8), st.integers(0, 4))
def test_distance(a, b, limit):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert distance(a, b, limit) == min(row[-1], limit + 1) == distance(b, a, limit)


@given(TEXT)
def test_folding(t):
    f = fold(t)
    assert fold(f) == f and f == f.strip() and "  " not in f
    assert fold(unicodedata.normalize("NFD", t)) == fold(unicodedata.normalize("NFC", t))
    assert same_words(f, fold(t.upper()), 0) or "ß" in t


@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_moves_cost_no_more_than_rewriting(r, h):
    assert 0 <= translation_edits(r, h) <= max(len(r), len(h))
    assert translation_edits(r, r) == 0
