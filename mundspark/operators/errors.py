"""Error rates of transcripts: word and character edit distance in the JVM, corpus rates, BLEU, chrF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mundspark.functions.normalise import words_only


#: The private-use planes, whose characters stand for the different tokens of a pair.
_PLANES = 0xF0000


def token_distance(a: str, b: str) -> Column:
    """Edit distance of two array columns, given by name: each different token of the pair is written as one character of
    its own, and the strings are compared letter by letter. A pair may have some 130,000 different tokens."""
    number = f"map_from_entries(transform(array_distinct(concat({a}, {b})), (t, i) -> struct(t, i)))"
    # a character is made from its UTF-32 bytes
    spell = lambda x: f"array_join(transform({x}, t -> decode(unhex(lpad(hex({_PLANES} + n[t]), 8, '0')), 'UTF-32')), '')"
    return F.expr(f"element_at(transform(array({number}), n -> levenshtein({spell(a)}, {spell(b)})), 1)")


def error_rates(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """df with word_edits, ref_words, wer, char_edits, ref_chars and cer, over normalised texts; characters without
    spaces. An empty reference has rate 0 if the hypothesis is empty too, else 1; NULL texts count as empty."""
    d = df.withColumn("_r", words_only(F.coalesce(reference, F.lit("")))).withColumn("_h", words_only(F.coalesce(hypothesis, F.lit(""))))
    d = d.withColumn("_rw", F.filter(F.split("_r", " "), lambda x: x != "")).withColumn("_hw", F.filter(F.split("_h", " "), lambda x: x != ""))
    rc, hc = F.replace("_r", F.lit(" "), F.lit("")), F.replace("_h", F.lit(" "), F.lit(""))
    d = d.withColumn("word_edits", token_distance("_rw", "_hw")).withColumn("ref_words", F.size("_rw"))
    d = d.withColumn("char_edits", F.levenshtein(rc, hc)).withColumn("ref_chars", F.length(rc))
    empty_w = F.when(F.col("_h") == "", 0.0).otherwise(1.0)
    empty_c = F.when(F.coalesce(hypothesis, F.lit("")) == "", 0.0).otherwise(1.0)
    wer = F.when(F.col("ref_words") == 0, empty_w).otherwise(F.col("word_edits") / F.col("ref_words"))
    cer = F.when(F.col("ref_chars") == 0, empty_c).otherwise(F.col("char_edits") / F.col("ref_chars"))
    return d.withColumn("wer", wer).withColumn("cer", cer).drop("_r", "_h", "_rw", "_hw")


def corpus_rates(rates: DataFrame, *groups: str) -> DataFrame:
    """Word and character error rate of all pairs together, per group: edits over reference length."""
    return rates.groupBy(*groups).agg(F.count(F.lit(1)).alias("pairs"), (F.sum("word_edits") / F.nullif(F.sum("ref_words"), F.lit(0))).alias("wer"), (F.sum("char_edits") / F.nullif(F.sum("ref_chars"), F.lit(0))).alias("cer"))


def _grams(tokens: str, n: int, sep: str) -> str:
    """The n-grams of an array column, sorted."""
    return f"sort_array(case when size({tokens}) < {n} then cast(array() as array<string>) else transform(sequence(1, size({tokens}) - {n} + 1), i -> array_join(slice({tokens}, i, {n}), '{sep}')) end)"


def _runs(grams: str) -> str:
    """How often each different n-gram of a sorted array occurs, as a map: runs are told by where they begin."""
    begins = f"filter(transform({grams}, (g, i) -> case when i = 0 or g <> {grams}[i - 1] then i end), i -> i is not null)"
    return f"""element_at(transform(array({begins}), b -> map_from_entries(transform(b, (i, k) -> struct({grams}[i], case when k + 1 < size(b) then b[k + 1] else size({grams}) end - i)))), 1)"""


def _counts(df: DataFrame, orders: range, sep: str) -> DataFrame:
    """df with columns m1, h1, r1, m2, ...: clipped matches of the n-grams of array columns _h and _r, and the n-grams of
    either. n-grams are sorted and counted once for each side."""
    for n in orders:
        df = df.withColumn("_gh", F.expr(_grams("_h", n, sep))).withColumn("_gr", F.expr(_grams("_r", n, sep)))
        df = df.withColumn("_ch", F.expr(_runs("_gh"))).withColumn("_cr", F.expr(_runs("_gr")))
        hit = F.expr("aggregate(map_entries(_ch), 0L, (s, e) -> s + least(e.value, coalesce(try_element_at(_cr, e.key), 0)))")
        df = df.withColumn(f"m{n}", hit).withColumn(f"h{n}", F.size("_gh").cast("long")).withColumn(f"r{n}", F.size("_gr").cast("long"))
    return df.drop("_gh", "_gr", "_ch", "_cr")


def bleu(df: DataFrame, reference: str, hypothesis: str, *groups: str) -> DataFrame:
    """(groups, bleu): corpus BLEU of 0 to 100 with up to 4-grams, one reference, white-space tokens, no smoothing but for
    orders without a match, which halve (exponential smoothing)."""
    d = df.select(*groups, F.split(F.trim(reference), r"\s+").alias("_r"), F.split(F.trim(hypothesis), r"\s+").alias("_h"))
    aggs = [F.sum(F.size("_r")).alias("rl"), F.sum(F.size("_h")).alias("hl")]
    for n in range(1, 5):
        aggs += [F.sum(f"m{n}").alias(f"m{n}"), F.sum(f"h{n}").alias(f"t{n}")]
    s = _counts(d, range(1, 5), "\\u0001").groupBy(*groups).agg(*aggs)
    smooth, log = F.lit(1.0), F.lit(0.0)
    for n in range(1, 5):
        smooth = F.when(F.col(f"m{n}") == 0, smooth * 2).otherwise(smooth)
        p = F.when(F.col(f"m{n}") == 0, 1 / (smooth * F.col(f"t{n}"))).otherwise(F.col(f"m{n}") / F.col(f"t{n}"))
        log = log + F.when(F.col(f"t{n}") > 0, F.log(p)).otherwise(F.lit(float("-inf")))
    brevity = F.when(F.col("hl") >= F.col("rl"), 0.0).otherwise(1 - F.col("rl") / F.col("hl"))
    return s.select(*groups, F.when(F.col("m1") == 0, 0.0).otherwise(100 * F.exp(log / 4 + brevity)).alias("bleu"))


def chrf(df: DataFrame, reference: str, hypothesis: str, *groups: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """(groups, chrf): corpus chrF of 0 to 100, character n-grams up to order without white space."""
    chars = lambda c: F.filter(F.split(F.regexp_replace(c, r"\s+", ""), ""), lambda x: x != "")
    d = df.select(*groups, chars(reference).alias("_r"), chars(hypothesis).alias("_h"))
    aggs = []
    for n in range(1, order + 1):
        aggs += [F.sum(f"{x}{n}").alias(f"{x}{n}") for x in "mhr"]
    s = _counts(d, range(1, order + 1), "").groupBy(*groups).agg(*aggs)
    total, used = F.lit(0.0), F.lit(0)
    for n in range(1, order + 1):
        both = (F.col(f"h{n}") > 0) & (F.col(f"r{n}") > 0)
        p, r = F.col(f"m{n}") / F.col(f"h{n}"), F.col(f"m{n}") / F.col(f"r{n}")
        f = F.when(p + r > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
        total = total + F.when(both, f).otherwise(0.0)
        used = used + both.cast("int")
    return s.select(*groups, F.coalesce(100 * total / F.nullif(used, F.lit(0)), F.lit(0.0)).alias("chrf"))


def _edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def translation_edits(reference: list[str], hypothesis: list[str], longest: int = 10, farthest: int = 50) -> int:
    """Fewest edits that a greedy search finds, a move of up to `longest` neighbouring words over at most `farthest`
    places counting as one. In each round the move that saves most is made, while one saves anything."""
    h, moves = list(hypothesis), 0
    cost = _edits(reference, h)
    while cost:
        best = None
        for n in range(min(longest, len(h)), 0, -1):
            for i in range(len(h) - n + 1):
                part = h[i : i + n]
                rest = h[:i] + h[i + n :]
                for j in range(len(reference) - n + 1):
                    if reference[j : j + n] == part and j != i and abs(i - j) <= farthest:
                        made = rest[:j] + part + rest[j:]
                        c = _edits(reference, made)
                        if best is None or c < best[0]:
                            best = (c, made)
        if best is None or best[0] + 1 >= cost:
            break
        cost, h, moves = best[0], best[1], moves + 1
    return cost + moves


def translation_edit_rate(df: DataFrame, reference: str, hypothesis: str, *groups: str) -> DataFrame:
    """(groups, ter): edits with moves over reference words, in percent, of all pairs together. The search for moves is no
    column expression and runs on Arrow batches."""
    import pandas as pd

    count = F.pandas_udf(lambda r, h: pd.Series([translation_edits((x or "").split(), (y or "").split()) for x, y in zip(r, h)], dtype="int64"), "long")
    words = F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), r"\s+"), lambda w: w != ""))
    d = df.select(*groups, count(F.col(reference), F.col(hypothesis)).alias("_e"), words.alias("_n"))
    return d.groupBy(*groups).agg((100 * F.sum("_e") / F.nullif(F.sum("_n"), F.lit(0))).alias("ter"))
