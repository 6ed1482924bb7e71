"""Delimited text in its many dialects: all-string tables, missing-value tokens, unquoted and ragged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mundspark.functions.columns import PLACEHOLDERS, phoneme_like, strip

#: Texts that readers of the reference data take for a missing value (fixed values).
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Rows of the master index by their number of fields: place of the phonemes and rank of the source; M are patched rows, F
#: guessed ones (fixed values).
RAGGED = {11: (10, 4), 9: (8, 4), 7: (6, 3), 6: (5, 3)}
PATCHED, GUESSED = 2, 1


def read_strings(spark: SparkSession, path: str | list[str], sep: str = "\t", missing: bool = False) -> DataFrame:
    """A table with header, all columns text. Blank fields are the empty text, tokens such as NA stay text; with missing,
    blanks and the tokens of NA are NULL instead. Doubled quotes inside quotes stand for one."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)
    if missing:
        return df.select(*[F.when(F.col(f"`{c}`").isin(*NA), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.fillna("")


def read_utterances(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_strings with every column stripped and the canton in capitals."""
    df = read_strings(spark, path)
    return df.select(*[(F.upper(strip(F.col(f"`{c}`"))) if c == "canton" else strip(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def read_typed(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = "\t") -> DataFrame:
    """A table with header and types, those of schema (DDL) or else inferred, which reads the data twice."""
    r = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file; an error if it has none."""
    row = spark.read.text(path).first()
    if row is None:
        raise ValueError(f"{path} is empty")
    return row[0]


def sniff(line: str, candidates: str = ",\t;|") -> str:
    """The delimiter that occurs most often in a line, the first candidate on a tie."""
    return max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """read_strings by the delimiter of the first line."""
    return read_strings(spark, path, sniff(first_line(spark, path)))


def read_unquoted(spark: SparkSession, paths: list[str], sep: str = "\t") -> DataFrame:
    """Tables of one header in which quotes mean nothing. Rows with more fields than the header are left out; those with
    fewer have NULLs at their end. Header lines of all files are left out."""
    header = first_line(spark, paths[0])
    names = header.split(sep)
    fields = F.split(F.col("value"), sep if sep not in "|.^$*+?" else f"\\{sep}", -1)
    rows = spark.read.text(paths).where((F.col("value") != header) & (F.col("value") != "")).select(fields.alias("f")).where(F.size("f") <= len(names))
    return rows.select(*[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_columns(spark: SparkSession, path: str | list[str], wanted: list[str], sep: str = "\t") -> DataFrame:
    """The wanted columns that the table has; the reader parses no others."""
    df = read_strings(spark, path, sep)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(wanted)])


def harvest_phonemes(spark: SparkSession, path: str, patch: DataFrame | None = None) -> DataFrame:
    """(clip_path, phoneme, rank) from a master index whose rows have 11, 9, 7 or 6 fields; of other rows the last field
    is taken if it looks like phonemes. patch has clip_path and phoneme of rows mended elsewhere. For each clip the best
    source wins, then the longer text, then the earlier row. Placeholders are no phonemes; the first line is a header."""
    header = first_line(spark, path)
    f = spark.read.text(path).where(F.col("value") != header).select(F.monotonically_increasing_id().alias("o"), F.split("value", "\t", -1).alias("f"))
    n = F.size("f")
    phones, rank = F.element_at("f", -1), F.lit(GUESSED)
    for size, (at, r) in RAGGED.items():
        phones = F.when(n == size, F.try_element_at("f", F.lit(at + 1))).otherwise(phones)
        rank = F.when(n == size, r).otherwise(rank)
    known = n.isin(*RAGGED) | phoneme_like(F.element_at("f", -1))
    rows = f.where(known).select(F.element_at("f", 1).alias("clip_path"), strip(phones).alias("phoneme"), rank.alias("rank"), "o")
    if patch is not None:
        rows = rows.unionByName(patch.select("clip_path", strip(F.col("phoneme")).alias("phoneme"), F.lit(PATCHED).alias("rank"), F.lit(1 << 62).alias("o")))
    rows = rows.where(~F.lower("phoneme").isin(*PLACEHOLDERS))
    best = rows.groupBy("clip_path").agg(F.max_by(F.struct("phoneme", "rank"), F.struct("rank", F.length("phoneme"), -F.col("o"))).alias("b"))
    return best.select("clip_path", "b.phoneme", "b.rank")


def inspect_lines(spark: SparkSession, path: str, start: int, count: int, sep: str = "\t") -> DataFrame:
    """(line, fields, values): lines start .. start + count - 1 of a file, from 0. Lines of 11 fields come with the 9 of
    the older layout, their third and fourth left out."""
    w = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), "value")
    rows = w.orderBy("o").offset(start).limit(count)  # only a window of lines is numbered
    f = F.split("value", sep, -1)
    nine = F.when(F.size("f") == 11, F.concat(F.slice("f", 1, 2), F.slice("f", 5, 7))).otherwise(F.col("f"))
    return rows.select((F.row_number().over(Window.orderBy("o")) - 1 + start).alias("line"), f.alias("f")).select("line", F.size("f").alias("fields"), nine.alias("values"))


def count_lines(spark: SparkSession, path: str | list[str]) -> int:
    return spark.read.text(path).count()


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, text) of a list of sentences; blank lines and those that begin with # are left out. Ids number the
    sentences from 1 as sentence_01."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), strip(F.col("value")).alias("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    n = F.row_number().over(Window.orderBy("o"))  # a list that people wrote: small
    return rows.select(F.concat(F.lit("sentence_"), F.lpad(n.cast("string"), 2, "0")).alias("sentence_id"), "text")


def read_metadata(spark: SparkSession, path: str, root: str, known: DataFrame | None = None) -> DataFrame:
    """(audio, text) of lines `audio|text` or `audio<TAB>text`; relative paths below root. known, with a column audio,
    keeps only those files."""
    v = F.col("value")
    at = F.locate("|", v)
    at = F.when(at > 0, at).otherwise(F.locate("\t", v))
    rows = spark.read.text(path).where(v.contains("|") | v.contains("\t")).select(strip(F.left(v, at - 1)).alias("audio"), strip(F.substr(v, at + 1)).alias("text"))
    rows = rows.select(F.when(F.col("audio").startswith("/"), F.col("audio")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("audio"))).alias("audio"), "text")
    return rows if known is None else rows.join(known.select("audio").distinct(), "audio", "left_semi")


def pattern_counts(spark: SparkSession, paths: list[str], patterns: list[str]) -> DataFrame:
    """(pattern, files, hits): texts that contain each pattern, whatever its case, and how often."""
    t = spark.read.text(paths, wholetext=True).select(F.lower("value").alias("v"))
    aggs = []
    for p in patterns:
        hits: Column = (F.length("v") - F.length(F.replace("v", F.lit(p.lower()), F.lit("")))) / len(p)
        aggs.append(F.struct(F.lit(p).alias("pattern"), F.count_if(F.col("v").contains(p.lower())).alias("files"), F.coalesce(F.sum(hits), F.lit(0.0)).cast("long").alias("hits")))
    return t.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
