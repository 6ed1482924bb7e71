"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

Merges are chosen by a rank queue: one bucket of linked-list positions per merge rank, and a bitmap in two levels over
the ranks, whose lowest set bit (find-first-set) is the next rank to merge. Entries that a neighbouring merge has made
stale are skipped when they come up. A pre-token of n bytes costs O(n log n) at worst, whatever its length.

Defined results: NULL and empty texts give an empty list; invisible and unassigned characters are encoded by their
bytes; strings of special tokens are ordinary text. Column names other than those asked for are left alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies and how text is cut before the merges; the pattern belongs to the vocabulary (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BITS = 256  # of one word of the lower bitmap
_CACHE = 300_000  # pre-tokens a worker remembers before it starts afresh
_LONG = 1 << 20  # characters from which a text's pre-tokens are no longer listed at once


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Vocabulary of a rank file: base64 bytes and rank on each line. Its size is that of the file, about 1 MB."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class Encoder:
    """Byte-level BPE over a rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern, self.cache = ranks, regex.compile(pattern), {}
        self.words = (max(ranks.values(), default=0) // _BITS) + 1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        # node i begins at byte i; ends[i] is where it ends, before[i] where the node left of it begins
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank at which node i merges with the next one
        buckets: dict[int, list[int]] = {}
        low, high = [0] * self.words, 0
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2], -1)
            pair[i] = r
            if r >= 0:
                if r not in buckets:
                    buckets[r] = []
                    low[r // _BITS] |= 1 << (r % _BITS)
                    high |= 1 << (r // _BITS)
                buckets[r].append(i)  # ascending, hence a heap
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            r = word * _BITS + (bits & -bits).bit_length() - 1
            heap = buckets[r]
            i = heappop(heap)
            if not heap:
                del buckets[r]
                low[word] = bits & (bits - 1)
                if not low[word]:
                    high &= high - 1
            if pair[i] != r:
                continue  # stale: a neighbour was merged since
            j = ends[i]  # the node that is swallowed
            end = ends[i] = ends[j]
            pair[j] = -1
            if end < n:
                before[end] = i
            for k, stop in ((i, ends[end] if end < n else 0), (before[i], end)):
                if k < 0:
                    continue
                new = ranks.get(piece[k:stop], -1) if stop else -1
                pair[k] = new
                if new >= 0:
                    if new not in buckets:
                        buckets[new] = []
                        low[new // _BITS] |= 1 << (new % _BITS)
                        high |= 1 << (new // _BITS)
                    heappush(buckets[new], k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text."""
        if not text:
            return []
        cache, ids = self.cache, []
        if len(cache) > _CACHE:
            cache.clear()
        pieces = self.pattern.findall(text) if len(text) < _LONG else (m[0] for m in self.pattern.finditer(text))
        for p in pieces:
            got = cache.get(p)
            if got is None:
                got = self.merge(p.encode())
                if len(p) < 64:
                    cache[p] = got
            ids += got
        return ids


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; costly per-row work should not wait for a few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def token_ids(df: DataFrame, key: str, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN, counts: bool = False, keep: dict[str, Column] | None = None) -> DataFrame:
    """(key, ids) of every row of df; with counts, (key, n_tokens) instead. keep adds columns of df, by name, between the
    two. Repeated keys give repeated rows."""
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())  # bounded by the vocabulary file
    narrow = df.select(F.col(key).alias("_key"), *[c.alias(f"_{i}") for i, c in enumerate((keep or {}).values())], text.alias("_text"))
    field = T.StructField("n_tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*narrow.schema.fields[:-1], field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(lines.value), pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                each = [encoder.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                made = pa.array([len(x) for x in each], pa.int64()) if counts else pa.array(each, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=schema.names)

    out = spread(narrow).mapInArrow(run, schema)
    return out.toDF(key, *(keep or {}), field.name)
