"""Text folding. The array functions run on Arrow arrays in C++, so that no Python loop touches a row."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for a missing text (fixed values).
MISSING = ("", "nan", "none", "null", "n/a", "na", "-", "?", "error", "no_phoneme")

_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"[\p{M}\p{Cf}]+")


def is_missing(c: Column, tokens: tuple[str, ...] = ("", "nan", "none", "null")) -> Column:
    """NULL, blank or one of the placeholder tokens, in any case."""
    return c.isNull() | F.lower(F.trim(c)).isin(*tokens)


def nfkc(c: Column) -> Column:
    """Unicode's compatible composed form, which the JVM has no function for: a pandas UDF, which ASCII texts pass by."""
    form = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)).astype(object), "string")
    return F.coalesce(form(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def fold_array(texts: pa.Array, umlauts: bool = True) -> pa.Array:
    """Words of each text, in lower case, NFKC, joined by one space; letters and digits only. umlauts: ä, ö, ü, ß are
    written ae, oe, ue, ss. NULL stays NULL."""
    # some versions of this function leave letters and marks apart, so both forms of an umlaut are dealt with
    a = pc.utf8_lower(pc.utf8_normalize(texts.cast(pa.string()), form="NFKC"))
    a = pc.replace_substring_regex(a, r"\p{Cf}+", "")
    for letter, one, two in (("a", "ä", "ae"), ("o", "ö", "oe"), ("u", "ü", "ue")):
        a = pc.replace_substring(a, letter + "\u0308", two if umlauts else one)
        a = pc.replace_substring(a, one, two) if umlauts else a
    if umlauts:
        a = pc.replace_substring(a, "ß", "ss")
    a = pc.replace_substring_regex(a, r"\p{M}+", "")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(a, r"[^\p{L}\p{N}]+", " "))


def fold(text: str | None, umlauts: bool = True) -> str:
    """fold_array for one text; NULL gives the empty text."""
    if not text:
        return ""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    if umlauts and not t.isascii():
        t = t.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")
    if not t.isascii():
        t = _MARKS.sub("", t)
    return " ".join(_WORD.findall(t))


def distance(a: str, b: str, limit: int) -> int:
    """Edit distance of two strings, or limit + 1 if it is above limit; only the band that matters is filled."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(limit + 1, len(a) + len(b))
    big = limit + 1
    row = {j: j for j in range(min(len(b), limit) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            v = i if j == 0 else min(row.get(j - 1, big) + (a[i - 1] != b[j - 1]), row.get(j, big) + 1, new.get(j - 1, big) + 1)
            new[j] = v
        if min(new.values()) > limit:
            return big
        row = new
    return min(big, row.get(len(b), big))


_DOWN = (("ae", "ä"), ("oe", "ö"), ("ue", "ü"))


def same_words(a: str, b: str, typos: int) -> bool:
    """Whether two folded texts (see fold) have the same words but for at most so many mistyped letters. Numbers must
    agree. A mistyped umlaut is one letter, so words that are too far apart when it is written as two are compared
    with one letter for each of ae, oe, ue as well."""
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return False
    left = typos
    for p, q in zip(x, y):
        if p != q:
            if left <= 0 or not p.isalpha() or not q.isalpha():
                return False
            d = distance(p, q, left)
            if d > 1:
                for two, one in _DOWN:
                    p, q = p.replace(two, one), q.replace(two, one)
                d = min(d, distance(p, q, left))
            left -= d
            if left < 0:
                return False
    return True
