"""Predicates and derived columns of utterance tables. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mundspark.functions.text import nfkc

#: Region of each canton (fixed values).
CANTON_REGION = {
    "AG": "Zürich", "ZH": "Zürich", "ZG": "Zürich",
    "LU": "Innerschweiz", "SZ": "Innerschweiz", "UR": "Innerschweiz", "NW": "Innerschweiz",
    "VS": "Wallis", "GR": "Graubünden",
    "TG": "Ostschweiz", "SG": "Ostschweiz", "AI": "Ostschweiz", "SH": "Ostschweiz",
    "BS": "Basel", "BL": "Basel", "BE": "Bern", "FR": "Bern",
}
#: Characters that mark a text as phonemes (fixed values).
PHONE_MARKS = "ːʃʒŋɲɡɾʊəɔœɐʏθðçɕʑɽɸβɣʁʔ"
#: Scripts that a German transcript does not use (fixed values).
FOREIGN_SCRIPTS = ("Hiragana", "Katakana", "Han", "Hangul", "Greek", "Cyrillic")
#: The word that a transcript puts for music, the dashes around it, and the marks of the end of a sentence and of a quotation after it (fixed values).
MUSIC, DASHES, SENTENCE_ENDS, CLOSING_QUOTES = "musik", "-–—", ".!?", "»\"'"
#: Tokens that count as a missing value, and those of phoneme checks besides (fixed values).
PLACEHOLDERS = ("", "nan", "null", "none")
PHONE_PLACEHOLDERS = (*PLACEHOLDERS, "no_phoneme", "error")


#: White space that is taken off the ends of a text (fixed values).
SPACE = " \t\n\r\x0b\x0c\x85\u00a0\u2002\u2003\u2009\u202f\u3000"


def strip(c: Column) -> Column:
    """Text without white space at its ends, no-break spaces included."""
    return F.btrim(c, F.lit(SPACE))


def lookup(c: Column, table: dict) -> Column:
    """Value of c in a small constant table; NULL where it is not listed."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def canton_region(canton: Column) -> Column:
    """Dialect region of a canton; the canton may be padded and in any case."""
    return lookup(F.upper(F.trim(canton)), CANTON_REGION)


def is_placeholder(c: Column, tokens: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """NULL, blank or a placeholder token in any case."""
    return F.coalesce(F.lower(strip(c)).isin(*tokens), F.lit(True))


def non_empty(c: Column) -> Column:
    """Not NULL and not blank; the text `nan` passes (see is_placeholder)."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def seconds(value: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Duration as a number of at least 0: unparsable, NULL and NaN count as 0, negative ones as 0. With start and end,
    their difference stands in for a missing value."""
    v = F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))
    if start is not None and end is not None:
        v = F.coalesce(v, F.nanvl(end.try_cast("double") - start.try_cast("double"), F.lit(None).cast("double")))
    return F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0))


def number_like(c: Column) -> Column:
    """An optional sign, then nothing but digits and dots."""
    return F.coalesce(strip(c).rlike(r"^[+-]?[\d.]*$") & (F.length(strip(c)) > 0), F.lit(False))


def phoneme_like(c: Column) -> Column:
    """A text of several tokens that has a phoneme mark or at least max(3, half) tokens that are not numbers."""
    t = strip(c)
    tokens = F.split(t, r"\s+")
    words = F.size(F.filter(tokens, lambda x: ~x.rlike(r"^[+-]?[\d.]*$")))
    enough = words >= F.greatest(F.lit(3), F.floor(F.size(tokens) / 2))
    return F.coalesce(~F.lower(t).isin(*PLACEHOLDERS) & t.contains(" ") & (t.rlike(f"[{PHONE_MARKS}]") | enough), F.lit(False))


def is_music(c: Column) -> Column:
    """Nothing but the word for music, with opening brackets, dashes and spaces before it, closing ones after it, and then
    perhaps a full stop. Wide and other compatible letters count as plain ones."""
    t = F.regexp_replace(F.rtrim(nfkc(c), F.lit(SPACE)), r"\.$", "")
    return F.coalesce(F.lower(F.rtrim(F.ltrim(t, F.lit(SPACE + "[(" + DASHES)), F.lit(SPACE + "])" + DASHES))) == MUSIC, F.lit(False))


def is_unknown_speaker(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)) == "UNKNOWN", F.lit(False))


def has_foreign_script(c: Column) -> Column:
    """Whether any letter belongs to a script that German does not use."""
    return F.coalesce(c.rlike("[" + "".join(rf"\p{{Is{x}}}" for x in FOREIGN_SCRIPTS) + "]"), F.lit(False))


def ends_sentence(c: Column) -> Column:
    """Whether the last character, but for white space and one closing quotation mark, ends a sentence."""
    t = F.rtrim(c, F.lit(SPACE))
    t = F.when(F.right(t, F.lit(1)).isin(*CLOSING_QUOTES), F.rtrim(F.left(t, F.length(t) - 1), F.lit(SPACE))).otherwise(t)
    return F.coalesce(F.right(t, F.lit(1)).isin(*SENTENCE_ENDS), F.lit(False))


def completeness(*cols: Column) -> Column:
    """How many of the columns are filled."""
    out = F.lit(0)
    for c in cols:
        out = out + non_empty(c).cast("int")
    return out


def votes(up: Column, down: Column) -> Column:
    """Up votes less down votes; what is not a whole number counts as 0."""
    return F.coalesce(up.try_cast("int"), F.lit(0)) - F.coalesce(down.try_cast("int"), F.lit(0))


def path_part(path: Column, back: int, default: str | None = None) -> Column:
    """The part so many places from the end of a path (1: the file); NULL or default where there are fewer."""
    p = F.nullif(F.try_element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.lit(-back)), F.lit(""))
    return p if default is None else F.coalesce(p, F.lit(default))


def speaker_folder(path: Column, prefix: str = "spk_") -> Column:
    """`<folder>/<prefix>...` of the last folder of a path that begins with prefix and has one above it; NULL without."""
    return F.nullif(F.regexp_extract(path, rf"^.*?(?:.*/)?([^/]+/{prefix}[^/]*)/", 1), F.lit(""))


def below(path: Column, anchor: str, until: str, default: str) -> Column:
    """The folders after anchor down to the first that begins with until; default where there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, rf"/{anchor}/((?:[^/]+/)*?{until}[^/]*)(?:/|$)", 1), F.lit("")), F.lit(default))


def url_client(url: Column) -> Column:
    """Client id in the address of an uploaded clip: the d parameter, or else the path, without folder and type, `__` for `/`."""
    rest = F.when(url.contains("?d="), F.substring_index(url, "?d=", -1)).otherwise(url)
    name = F.substring_index(F.substring_index(rest, "local-files:", -1), "/", -1)
    return F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("__"), F.lit("/"))


def safe_name(c: Column, limit: int = 200) -> Column:
    """A text as a file name: forbidden characters out, white space to one underscore, at most limit characters."""
    return F.left(F.regexp_replace(F.trim(F.regexp_replace(c, r'[<>:"/\\|?*]', "")), r"\s+", "_"), F.lit(limit))


def slug_title(c: Column) -> Column:
    """A slug as a title: hyphens and underscores to spaces, words capitalised."""
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def absolute_path(path: Column, folder: Column) -> Column:
    """path if it is absolute, else below folder; NULL where either is missing."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), path))


def duration_mismatch(start: Column, end: Column, duration: Column, tolerance: float) -> Column:
    """Whether end - start differs from duration by more than tolerance; what cannot be parsed is a mismatch."""
    d = F.abs(end.try_cast("double") - start.try_cast("double") - duration.try_cast("double"))
    return F.coalesce(F.isnan(d) | (d > tolerance), F.lit(True))


def is_german(index: Column, name: Column, probability: Column, german: tuple[str, ...], dialect: tuple[str, ...]) -> Column:
    """A speaker's prediction from the first column that tells: label index 0 or 1, label name, probability of at least
    0.5; -1 if none does."""
    i = index.try_cast("double").cast("int")
    n = F.lower(F.trim(name))
    p = F.nanvl(probability.try_cast("double"), F.lit(None).cast("double"))
    return F.when(i.isin(0, 1), i).when(n.isin(*german), 1).when(n.isin(*dialect), 0).when(p.isNotNull(), (p >= 0.5).cast("int")).otherwise(-1)


def argmax(values: Column) -> Column:
    """Index, from 0, of the largest value of an array, the first on a tie; NULL for an empty one."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)).cast("int") - 1


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; NULL if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def decision(mean: Column, median: Column, rule: str) -> Column:
    """German (1) or dialect (0) from a speaker's chunk probabilities: by `mean` at least 0.5, or by `median` above 0.4."""
    if rule not in ("mean", "median"):
        raise ValueError(f"no rule {rule}")
    return (mean >= 0.5).cast("int") if rule == "mean" else (median > 0.4).cast("int")


def real_time_factor(wall_seconds: Column, audio_seconds: Column) -> Column:
    """Seconds of work for a second of audio; NULL without audio."""
    return wall_seconds / F.when(audio_seconds > 0, audio_seconds)
