"""Problem 10: the language of each document and of each part of a mixed one.

Texts are cut into sentences, without mark-up, labels, phonetic writing and quoted titles. For every character
n-gram of a sentence a bit-sliced Bloom filter gives the set of languages that contain it: one byte a slot, one bit a
language, the AND of the slots of HASHES hash functions. The n-grams of each language are counted (a popcount over the
bytes), the count that the filter's false positives would give is taken off, and the language with the largest share of
the sentence's n-grams wins; the lead over the next one is the confidence.

The filter is fitted on a bounded sample of labelled documents (FIT_DOCS for each language, by hash order). An n-gram
belongs to a language if it is about as frequent there as where it is most frequent, so that a minority of wrong labels
does no harm; a second pass counts the n-grams over sentences labelled by the first, which also undoes mixed documents.
Everything else covers all documents. The filter's size, FILTER_BYTES, does not depend on the data.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.llm.tokenize import spread
from mundspark.operators.prefix import first_n, uniform

LANGUAGES = ("de", "gsw", "fr", "it", "en")
#: Spellings of the languages in labels, in lower case with hyphens for underscores (fixed values).
SPELLINGS = {
    "de": ("de", "de-de", "de-ch", "de-at", "deu", "ger", "german", "deutsch", "hochdeutsch"),
    "gsw": ("gsw", "gsw-ch", "als", "swiss german", "schweizerdeutsch", "alemannic", "swissgerman", "mundart"),
    "fr": ("fr", "fr-fr", "fr-ch", "fra", "fre", "french", "français", "francais", "französisch"),
    "it": ("it", "it-it", "it-ch", "ita", "italian", "italiano", "italienisch"),
    "en": ("en", "en-gb", "en-us", "eng", "english", "englisch", "anglais"),
}
FIT_DOCS = 800
FILTER_BYTES, HASHES, SIZES = 1 << 20, 3, (3, 4, 5)
#: Share of the largest relative frequency that an n-gram needs to belong to a language, and its least count.
TYPICAL, LEAST = 0.2, 2
#: Share of n-grams, and lead over the next language, of a sentence that may add a language to a document; and those of one
#: of fewer than SHORT words, which has fewer n-grams to tell by and must end like a sentence. A single word follows the rest.
SURE, LEAD, SHORT, SHORT_SURE, SHORT_LEAD = 0.6, 0.12, 4, 0.8, 0.4

_TITLE = re.compile(r"«[^«»]+»|„[^„“”]+[“”]|“[^“”]+”|\"[^\"]+\"")
_QUOTE = re.compile(r"[«„“\"]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_LABEL = re.compile(r"^\s*(?:[\[(<]?\s*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*[\])>]?)?\s*(?:[A-Za-z]+[_ -]?\d{1,4}\s*:)?")
_PHONES = re.compile(r"/[^/\n]{3,}/")
_END = re.compile(r"(?<=[.!?…])[\s\"'»”)]+|\t|\|")
_WHOLE = re.compile(r"[.!?…][\"'»”)\s]*$")
#: Letters of phonetic writing: the blocks of phonetic letters, and length and stress marks (fixed values).
_PHONETIC = re.compile("[\u0250-\u02af\u02c8\u02cc\u02d0\u02d1\u1d00-\u1dbf]")
_WORD = re.compile(r"[^\W\d_]+")
_INVISIBLE = regex.compile(r"\p{Cf}+")


def language_of_label(lang: Column) -> Column:
    """The language a label names in any spelling; NULL for a missing label, a placeholder or another language."""
    known = F.create_map(*[F.lit(x) for code, names in SPELLINGS.items() for n in names for x in (n, code)])
    return F.try_element_at(known, F.replace(F.lower(F.trim(lang)), F.lit("_"), F.lit("-")))


def _without_titles(line: str) -> str:
    """A quotation that is no whole sentence, such as a title, says nothing of the language around it. It counts only where
    there is nothing else."""
    if not _QUOTE.search(line):
        return line
    rest = _TITLE.sub(lambda m: m[0] if re.search(r"[.!?…]", m[0]) else " ", line)
    return rest if _WORD.search(rest) else line


def is_phonetic(part: str) -> bool:
    """Whether a text is phonetic writing: sounds apart, most of them of one or two letters, phonetic letters among them."""
    if not _PHONETIC.search(part):
        return False
    sounds = part.split()
    return 2 * sum(len(x) <= 2 for x in sounds) > len(sounds) and 10 * sum(_PHONETIC.search(x) is not None for x in sounds) >= len(sounds)


def sentences(text: str | None) -> list[tuple[str, int, bool]]:
    """(folded sentence, its number of words, whether it is long or ends like one) of a text in order; cells of a table are sentences
    each, and parts without words are left out."""
    if not text:
        return []
    t = text if text.isascii() else unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    out = []
    for line in _TAG.sub("\n", t.replace("\r", "\n")).split("\n"):
        if not line or line.isspace():
            continue
        line = _without_titles(line)
        line = _LABEL.sub("", _PHONES.sub(" ", line) if "/" in line else line)
        for part in _END.split(line):
            words = _WORD.findall(part.lower())
            if words and (part.isascii() or not is_phonetic(part)):
                # a sentence long enough to tell by need not end like one
                out.append((" ".join(words), len(words), len(words) >= SHORT or _WHOLE.search(part) is not None))
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every n-gram of the texts, with a space at either end."""
    joined = " " + "  ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    owners, hashes = [], []
    h = np.full(len(codes), 0x243F6A8885A308D3, dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):  # each size goes on from the one before
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in SIZES:
            inside = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][inside])
            hashes.append(h[inside] ^ np.uint64(n))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    a = h * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(32)
    step = (a >> np.uint64(20)) | np.uint64(1)
    return [((a + np.uint64(k) * step) & np.uint64(FILTER_BYTES - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    """The bit-sliced filter: one byte a slot, bit i for language i."""

    def __init__(self, members: list[np.ndarray]):
        self.bytes = np.zeros(FILTER_BYTES, dtype=np.uint8)
        for i, h in enumerate(members):
            for s in _slots(h):
                self.bytes[s] |= np.uint8(1 << i)
        #: chance that a foreign n-gram seems to be of language i
        self.false = np.array([float(((self.bytes >> i) & 1).mean()) ** HASHES for i in range(len(members))])

    def shares(self, texts: list[str]) -> np.ndarray:
        """Share of each text's n-grams in each language, corrected for false positives; 0 for a text without any."""
        owner, h = _grams(texts)
        mask = np.full(len(h), 255, dtype=np.uint8)
        for s in _slots(h):
            mask &= self.bytes[s]
        # one count of every (text, set of languages), then the sets that hold each language
        sets = 1 << len(self.false)
        table = np.bincount(owner * sets + (mask & np.uint8(sets - 1)), minlength=len(texts) * sets).reshape(len(texts), sets).astype(float)
        n = table.sum(axis=1)
        out = np.zeros((len(texts), len(self.false)))
        for i, p in enumerate(self.false):
            c = table[:, (np.arange(sets) >> i) & 1 == 1].sum(axis=1)
            out[:, i] = np.clip((c - p * n) / np.maximum(n * (1 - p), 1e-9), 0, 1)
        return out


def _members(labelled: list[tuple[str, int]], languages: int) -> list[np.ndarray]:
    """The n-grams that belong to each language, from (text, language number) pairs."""
    found = []
    for i in range(languages):
        texts = [t for t, k in labelled if k == i]
        h = _grams(texts)[1] if texts else np.zeros(0, np.uint64)
        found.append(np.unique(h, return_counts=True))
    everything = np.unique(np.concatenate([f[0] for f in found]))
    rate = np.zeros((languages, len(everything)))
    count = np.zeros((languages, len(everything)))
    for i, (h, c) in enumerate(found):
        at = np.searchsorted(everything, h)
        count[i, at] = c
        rate[i, at] = c / max(c.sum(), 1)
    top = rate.max(axis=0)
    return [everything[(rate[i] >= TYPICAL * top) & (count[i] >= LEAST)] for i in range(languages)]


def fit_filter(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageFilter:
    """A filter from at most FIT_DOCS documents of each labelled language."""
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), language_of_label(F.col(lang)).alias("lang"), uniform(F.col(key), F.xxhash64(text), seed=5).alias("u")).where("lang is not null and text is not null")
    quota = spark.createDataFrame([(x, FIT_DOCS) for x in LANGUAGES], "lang string, n int")
    rows = first_n(named, ["lang"], "u", "key", quota, "n").select("lang", "text").collect()  # bounded by FIT_DOCS
    number = {x: i for i, x in enumerate(LANGUAGES)}
    pairs = [(s, number[r.lang]) for r in sorted(rows, key=lambda r: (r.lang, r.text)) for s, _, _ in sentences(r.text)]
    if not pairs:
        return LanguageFilter([np.zeros(0, np.uint64) for _ in LANGUAGES])
    for _ in range(2):
        shares = LanguageFilter(_members(pairs, len(LANGUAGES))).shares([s for s, _ in pairs])
        best = shares.argmax(axis=1)
        lead = shares.max(axis=1) - np.partition(shares, -2, axis=1)[:, -2]
        again = [(s, int(b)) for (s, _), b, d in zip(pairs, best, lead) if d > 0.02]
        pairs = again or pairs
    return LanguageFilter(_members(pairs, len(LANGUAGES)))


def decide(parts: list[tuple[str, int, bool]], shares: np.ndarray) -> tuple[list[tuple[int, float]], list[int]]:
    """([(language number, confidence)] of a document, language number of each of its parts)."""
    if not parts:
        return [], []
    words = np.array([n for _, n, _ in parts], dtype=float)
    total = (shares * words[:, None]).sum(axis=0)
    if total.max() <= 0:
        return [], [-1] * len(parts)
    order = np.sort(shares, axis=1)
    lead = order[:, -1] - order[:, -2]
    best = shares.argmax(axis=1)
    short = np.array([w for _, _, w in parts]) & (words > 1) & (order[:, -1] >= SHORT_SURE) & (lead >= SHORT_LEAD)
    sure = np.where(words >= SHORT, (order[:, -1] >= SURE) & (lead >= LEAD), short)
    own = {int(b) for b in best[sure]} or {int(total.argmax())}
    each = []
    for k in range(len(parts)):
        each.append(max(own, key=lambda i: (shares[k, i], total[i])))
    each = np.array(each)
    out = []
    for i in sorted(own):
        mine = each == i
        if mine.any():
            others = np.delete(shares[mine], i, axis=1).max(axis=1)
            a = float((shares[mine, i] * words[mine]).sum())
            b = float((others * words[mine]).sum())
            out.append((i, round(a / max(a + b, 1e-9), 4)))
    return out, each.tolist()


def _each(docs: DataFrame, key: str, text: str, lang: str, model: LanguageFilter, parts: bool) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(model)  # FILTER_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500)
                each = [sentences(t) for t in c.column(1).to_pylist()]
                flat = [s for x in each for s, _, _ in x]
                shares = known.value.shares(flat) if flat else np.zeros((0, len(LANGUAGES)))
                rows, i = [], 0
                for k, given, x in zip(c.column(0).to_pylist(), c.column(2).to_pylist(), each):
                    langs, of = decide(x, shares[i : i + len(x)])
                    if parts:
                        rows += _stretches(k, x, of, shares[i : i + len(x)]) if len(langs) > 1 else []
                    else:
                        rows += [(k, LANGUAGES[n], p, len(langs), given) for n, p in langs]
                    i += len(x)
                cols = list(zip(*rows)) if rows else [()] * 5
                types = [c.column(0).type, pa.int32(), pa.string(), pa.float64(), pa.string()] if parts else [c.column(0).type, pa.string(), pa.float64(), pa.int32(), pa.string()]
                names = ["key", "part", "lang", "confidence", "words"] if parts else ["key", "lang", "confidence", "languages", "given"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, part int, lang string, confidence double, words string" if parts else f"key {kind}, lang string, confidence double, languages int, given string"
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), language_of_label(F.col(lang)).alias("given"))
    return spread(narrow.where("text is not null")).mapInArrow(run, schema)


def _stretches(key, parts: list[tuple[str, int, bool]], of: list[int], shares: np.ndarray) -> list[tuple]:
    out, i = [], 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and of[j + 1] == of[i]:
            j += 1
        mine = shares[i : j + 1, of[i]].mean()
        others = np.delete(shares[i : j + 1], of[i], axis=1).max(axis=1).mean()
        out.append((key, len(out), LANGUAGES[of[i]], round(float(mine / max(mine + others, 1e-9)), 4), " ".join(s for s, _, _ in parts[i : j + 1])))
        i = j + 1
    return out


def document_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, confidence, languages): a row for each language that a document is written in, with the number of
    them. Texts without words give no row; NULL and empty texts neither. A language counts if at least one whole
    sentence outside quoted titles is in it. Where no document has a usable label, there is no model and no row."""
    return _each(docs, key, text, lang, fit_filter(docs, key, text, lang), False).drop("given").withColumnRenamed("key", key)


def mixed_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, part, lang, confidence, words): the stretches of one language of each document written in several."""
    return _each(docs, key, text, lang, fit_filter(docs, key, text, lang), True).withColumnRenamed("key", key)


def label_faults(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang) of documents whose label is missing or names another language, or which have several languages."""
    found = _each(docs, key, text, lang, fit_filter(docs, key, text, lang), False)
    return found.where("languages > 1 or given is null or given <> lang").select(F.col("key").alias(key), "lang")
