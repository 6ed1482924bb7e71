"""Problem 1: records of evaluation splits that the training split holds too.

Texts are compared through suffix arrays over their concatenation. Folded texts are partitioned by speaker, the texts of a
partition are written one after the other, and the suffixes at all words are sorted by prefix doubling: the rank of a
suffix's first 2h words follows from the ranks of its first h words and of the h words after them. The ranks of all
levels also give the common prefix of neighbours in the array. Two readings of the array are used.

Pairs. A text of W words is read as a ring. If two texts of one speaker differ in at most two words, those cut the ring
into two shared spans, the longer of at least L = (W - 2) / 2 words (rounded up). So the pair has neighbouring suffixes,
at the same place of texts of the same length, whose common prefix is L words or more. Runs of the array with such
prefixes that hold both splits give the candidates: pairs whose spans cover all but two words are compared exactly, in
place. A run whose pairs would outnumber its texts by more than PAIRS (sentences of one pattern, say) is not paired: its
texts go on to keys that spell the uncovered words with letters left out, of which only texts that may be the same share
one. Texts of one or two words have no span left and have such keys from the start.

Coverage. A span of SPAN words (the whole text, if that is shorter) of an evaluation text is shared if the run of suffixes
with that common prefix holds a training suffix; shared spans are merged into the words covered.

Texts are those of distinct (speaker, text) classes, so copies of a record cost no further suffixes. A speaker with more
than TEXTS records is split into bins by a hash of the words that a common prefix must have; a text is sent to those bins
that one of its suffixes falls into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mundspark.functions.keys import file_key, speaker_key
from mundspark.functions.text import fold_array, same_words
from mundspark.llm.bitmaps import bitmap, in_bitmap, slot_of
from mundspark.runtime import staged, width

#: Letters that may be mistyped between two records with the same words.
TYPOS = 2
#: Folded texts that stand for a missing sentence (fixed values).
NO_SENTENCE = ("", "nan", "none", "null")
#: Records of a speaker above which its suffixes are split into bins, and texts of a partition sorted together.
TEXTS = 50_000
#: Pairs for each text of a run that are compared directly.
PAIRS = 64
#: Uncovered words that are spelled out; more of them are first cut into parts, of which one must agree.
FREE = 12
#: Words of a shared span.
SPAN = 5
#: Letters above which a word is not spelled with letters left out, but cut.
_LONG_WORD = 40


def _without(word: str, n: int) -> set[str]:
    """The spellings of a word with up to n letters left out. Two words at most n edits apart have one in common."""
    out = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _thirds(word: str, side: int) -> list[str]:
    """Pieces of a long word of which two words few edits apart share one: its first and last third, and its middle, which
    the evaluation side offers at all places to which letters left out or doubled can have moved it."""
    out, slack = [], 2 * TYPOS
    for size in {1 << max((len(word) + d) // 4, 1).bit_length() - 1 for d in (-slack, 0, slack)}:
        out += [f"<{size}{word[:size]}", f">{size}{word[-size:]}"]
        at = (len(word) - size) // 2
        out += [f"={size}{word[at + d : at + d + size]}" for d in (range(-slack, slack + 1) if side & 2 else (0,))]
    return out


def near(word: str, n: int, side: int) -> set[str]:
    """Keys of a word, of which two words with up to n mistyped letters share one. A mistyped umlaut is one letter, so the
    word is also taken with one letter for each of ae, oe, ue. Words about _LONG_WORD letters long have both kinds of key,
    so that two words on either side of that length meet."""
    out: set[str] = set()
    for w in {word, word.replace("ae", "ä").replace("oe", "ö").replace("ue", "ü")}:
        if len(w) <= _LONG_WORD + 2 * TYPOS:
            out |= _without(w, n)
        if len(w) > _LONG_WORD - 2 * TYPOS:
            out.update(_thirds(w, side))
    return out


def tolerant_keys(words: list[str], free: list[int], side: int) -> Iterator[str]:
    """Keys of a text, of which two texts share one if they differ in free places only, by up to TYPOS mistyped letters.
    Numbers are never mistyped."""
    may = [i for i in free if words[i].isalpha()]
    one = {i: near(words[i], 1, side) for i in may} if len(may) > 1 else {}
    for x, i in enumerate(may):
        rest = "|".join([*words[:i], "", *words[i + 1 :]])
        for k in near(words[i], TYPOS, side):
            yield f"{i}|{rest}|{k}"
        for j in may[x + 1 :]:
            rest = "|".join([*words[:i], "", *words[i + 1 : j], "", *words[j + 1 :]])
            for k in one[i]:
                for m in one[j]:
                    yield f"{i},{j}|{rest}|{k}|{m}"


def arc(words: int) -> int:
    """Words of the span that two rings of so many words share at least if two words differ."""
    return max(1, (words - TYPOS + 1) // 2)


class SuffixArray:
    """Sorted suffixes of texts, given as word numbers: codes[offsets[t]:offsets[t + 1]] are the words of text t. Suffixes
    of different groups of texts have no prefix in common. With ring, each text goes on into its beginning, as far as
    arc; prefixes are told apart up to depth words."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, group: np.ndarray, depth: int, ring: bool):
        lengths = np.diff(offsets)
        extra = np.array([arc(int(w)) - 1 for w in range(int(lengths.max(initial=0)) + 1)])[lengths] if ring else np.zeros(len(lengths), np.int64)
        total = lengths + extra + 1
        begin = np.cumsum(total) - total
        self.text = np.repeat(np.arange(len(lengths)), total)
        self.place = np.arange(len(self.text)) - begin[self.text]
        real = self.place < (lengths + extra)[self.text]
        known = int(codes.max(initial=0)) + 1
        # every text ends with a sign of its own, so that no common prefix goes over an end
        symbols = known + self.text
        t = self.text[real]
        symbols[real] = codes[offsets[t] + self.place[real] % lengths[t]]
        names = np.unique(group[self.text] * (known + len(lengths)) + symbols, return_inverse=True)[1]
        self.levels, h = [names], 1
        while h < depth:
            after = np.zeros(len(names), np.int64)
            after[: len(names) - h] = names[h:] + 1
            names = np.unique(names * (len(names) + 1) + after, return_inverse=True)[1]
            self.levels.append(names)
            h *= 2

    def sorted(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the starts in the order of their suffixes, the common prefix of each with the one before; -1 for the first)"""
        order = starts[np.argsort(self.levels[-1][starts], kind="stable")]
        a, b = order[:-1], order[1:]
        common = np.zeros(len(a), np.int64)
        last = len(self.text) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a + common, b + common
            same = (x <= last) & (y <= last)
            same &= self.levels[k][np.minimum(x, last)] == self.levels[k][np.minimum(y, last)]
            common += same.astype(np.int64) << k
        return order, np.concatenate([[-1], common]) if len(order) else common


class _Block:
    """Texts of some (speaker, bin) groups, held together."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.speaker, self.bin, self.bins = (rows.column(c).to_numpy() for c in ("speaker", "bin", "bins"))
        self.cls, self.side, self.main = (rows.column(c).to_numpy() for c in ("class", "side", "main"))
        self.strings = rows.column("text")
        lists = pc.split_pattern(self.strings.combine_chunks(), " ")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        d = lists.flatten().dictionary_encode()
        # words are numbered in their alphabetical order
        spelled = d.dictionary.to_numpy(zero_copy_only=False)
        rank = np.empty(len(spelled), np.int64)
        rank[np.argsort(spelled, kind="stable")] = np.arange(len(spelled))
        self.codes = rank[d.indices.to_numpy(zero_copy_only=False)] if len(spelled) else np.zeros(0, np.int64)
        self.hashes = word_hashes(spelled)[d.indices.to_numpy(zero_copy_only=False)] if len(spelled) else np.zeros(0, np.uint64)
        self.offsets = offsets - offsets[0]
        self.lengths = np.diff(self.offsets)
        new = np.ones(len(self.speaker), bool)
        new[1:] = (self.speaker[1:] != self.speaker[:-1]) | (self.bin[1:] != self.bin[:-1])
        self.group = np.cumsum(new) - 1

    def both_sides(self) -> np.ndarray:
        """Which texts are in a group that holds both splits."""
        n = int(self.group[-1]) + 1
        return ((np.bincount(self.group, self.side & 1, n) > 0) & (np.bincount(self.group, self.side & 2, n) > 0))[self.group]


def word_hashes(words) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (the finaliser of a common public hash)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def suffix_bins(hashes: np.ndarray, bins: int, ring: bool) -> list[tuple[int, int, int]]:
    """(place, words, bin) of each common prefix that a text may have to share: at every place arc words of the ring, or
    else 1 to SPAN words before the end."""
    w, out = len(hashes), []
    with np.errstate(over="ignore"):
        for p in range(w):
            key = np.uint64(w * 0x9E3779B9 + p + 1) if ring else np.uint64(1)
            for k in range(arc(w) if ring else min(SPAN, w - p)):
                key = _mix(key * np.uint64(31) + hashes[(p + k) % w])
                if not ring:
                    out.append((p, k + 1, int(key % np.uint64(bins))))
            if ring:
                out.append((p, arc(w), int(key % np.uint64(bins))))
    return out


def _spread(ring: bool) -> Callable:
    """Rows (speaker, class, side, text, bins) to one row for each bin of the text, the first of them the main one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, bin_ = np.arange(b.num_rows), np.zeros(b.num_rows, np.int32)
            bins = b.column("bins").to_numpy()
            main = np.ones(b.num_rows, bool)
            split = np.flatnonzero(bins > 1)
            if len(split):
                texts = b.column("text").take(pa.array(split)).to_pylist()
                more_own, more_bin = [], []
                for r, t in zip(split.tolist(), texts):
                    words = t.split(" ")
                    # short texts meet by their keys, not by spans
                    found = {len(words) % int(bins[r])} if ring and len(words) <= TYPOS else {x[2] for x in suffix_bins(word_hashes(words), int(bins[r]), ring)}
                    first, *rest = sorted(found)
                    bin_[r] = first
                    more_own += [r] * len(rest)
                    more_bin += rest
                own = np.concatenate([own, np.array(more_own, np.int64)])
                bin_ = np.concatenate([bin_, np.array(more_bin, np.int32)])
                main = np.concatenate([main, np.zeros(len(more_own), bool)])
            rows = b.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("speaker", "class", "side", "text", "bins")), pa.array(bin_), pa.array(main)], names=["speaker", "class", "side", "text", "bins", "bin", "main"])

    return run


def suffix_arrays(records: DataFrame, work: Callable[[_Block], pa.RecordBatch], schema: str, parts: int, ring: bool) -> DataFrame:
    """What work yields for the texts of all speakers, some groups at a time. records: speaker, class, side, text."""
    many = staged(records.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TEXTS).select("speaker", F.ceil(F.col("n") / TEXTS).cast("int").alias("bins")), "large-speakers")
    classes = records.groupBy("speaker", "class").agg(F.bit_or("side").alias("side"), F.first("text").alias("text"))
    binned = classes.join(many, "speaker", "left").select("speaker", "class", "side", "text", F.coalesce("bins", F.lit(1)).alias("bins"))
    binned = binned.mapInArrow(_spread(ring), "speaker long, class long, side int, text string, bins int, bin int, main boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            s, g = b.column("speaker").to_numpy(), b.column("bin").to_numpy()
            cut = np.flatnonzero((s[1:] != s[:-1]) | (g[1:] != g[:-1])) + 1
            if n and b.num_rows and (held[-1].column("speaker")[-1].as_py(), held[-1].column("bin")[-1].as_py()) != (s[0], g[0]):
                cut = np.concatenate([[0], cut])
            if n + b.num_rows >= TEXTS and len(cut):
                at = int(cut[-1])
                if at:
                    held.append(b.slice(0, at))
                yield work(_Block(pa.Table.from_batches(held)))
                held, n = [], 0
                b = b.slice(at)
            held.append(b)
            n += b.num_rows
        if n:
            yield work(_Block(pa.Table.from_batches(held)))

    return binned.repartition(parts, "speaker", "bin").sortWithinPartitions("speaker", "bin").mapInArrow(run, schema)


_FOUND = "kind int, speaker long, a long, b long, side int, text string, free array<int>"
_ARROW = pa.schema([("kind", pa.int32()), ("speaker", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32()), ("text", pa.string()), ("free", pa.list_(pa.int32()))])


def _bin_of(block: _Block, text: np.ndarray, place: np.ndarray, n: np.ndarray, ring: bool) -> np.ndarray:
    """The bin of each suffix, by its first n words; as suffix_bins."""
    w = block.lengths[text]
    key = (w * 0x9E3779B9 + place + 1).astype(np.uint64) if ring else np.ones(len(text), np.uint64)
    for k in range(int(n.max(initial=0))):
        on = k < n
        key[on] = _mix(key[on] * np.uint64(31) + block.hashes[block.offsets[text[on]] + (place[on] + k) % w[on]])
    return (key % block.bins[text].astype(np.uint64)).astype(np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the run of each place of the order) of equal keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) if len(k) else order


def _crossing(run: np.ndarray, train: np.ndarray, ev: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place of a training member, place of an evaluation member) within runs, some at a time. run ascends."""
    left = np.flatnonzero(train)
    n = np.bincount(run[left], minlength=int(run[-1]) + 1)
    first = np.cumsum(n) - n
    right = np.flatnonzero(ev)
    each = n[run[right]]
    right, each = right[each > 0], each[each > 0]
    part = np.cumsum(each) // (1 << 20)
    for x in np.unique(part):
        r, e = right[part == x], each[part == x]
        k = np.arange(int(e.sum())) - np.repeat(np.cumsum(e) - e, e)
        yield left[np.repeat(first[run[r]], e) + k], np.repeat(r, e)


def _pairs_of(block: _Block) -> pa.RecordBatch:
    """kind 0: (speaker, training class a, evaluation class b) of texts with the same words. kind 1: members (bucket a,
    class b, side, text, free places) of runs with too many pairs, and texts of one or two words."""
    import xxhash

    rows: list[list] = [[] for _ in _ARROW]

    def put(kind: int, at: np.ndarray, a, b, text=None, free=None) -> None:
        n = len(at)
        for c, v in zip(rows, ([kind] * n, block.speaker[at].tolist(), list(a), list(b), block.side[at].tolist(), text or [None] * n, free or [None] * n)):
            c.extend(v)

    own = np.flatnonzero((block.side == 3) & block.main)
    put(0, own, block.cls[own].tolist(), block.cls[own].tolist())
    keep = block.both_sides()
    short = np.flatnonzero(keep & (block.lengths <= TYPOS) & block.main)
    if len(short):
        w = block.lengths[short].tolist()
        put(1, short, [_signed(xxhash.xxh64_intdigest(f"{s}|{n}")) for s, n in zip(block.speaker[short].tolist(), w)], block.cls[short].tolist(), block.strings.take(pa.array(short)).to_pylist(), [list(range(n)) for n in w])
    used = keep & (block.lengths > TYPOS)
    if used.any():
        arcs = np.array([arc(int(w)) for w in range(int(block.lengths.max()) + 1)])
        # texts that are not used keep their number, but no words
        lengths = np.where(used, block.lengths, 0)
        words = np.repeat(used, block.lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        codes = block.codes[words]
        sa = SuffixArray(codes, offsets, block.group, int(arcs[lengths.max()]), True)
        starts = np.flatnonzero(sa.place < lengths[sa.text])
        split = block.bins[sa.text[starts]] > 1
        if split.any():
            s = starts[split]
            at = sa.text[s]
            split[split] = _bin_of(block, at, sa.place[s], arcs[block.lengths[at]], True) != block.bin[at]
            starts = starts[~split]
        order, common = sa.sorted(starts)
        length = lengths[sa.text[order]]
        seen: list[np.ndarray] = []
        n = len(lengths)
        for w in np.unique(length):
            at = np.flatnonzero(length == w)
            run = np.cumsum(common < arcs[w])[at]
            place = sa.place[order[at]]
            by, bucket = _runs(run * int(w) + place)
            text, place = sa.text[order[at]][by], place[by]
            train, ev = (block.side[text] & 1) != 0, (block.side[text] & 2) != 0
            na, nb = np.bincount(bucket, train), np.bincount(bucket, ev)
            size = np.bincount(bucket)
            cross = (na > 0) & (nb > 0) & (size > 1)
            heavy = cross & (na * nb > PAIRS * (na + nb))
            on = (cross & ~heavy)[bucket]
            grid = None
            if on.any():
                t, b = text[on], bucket[on]
                ids, row = np.unique(t, return_inverse=True)
                grid = codes[offsets[ids][:, None] + np.arange(w)]
                for x, y in _crossing(np.unique(b, return_inverse=True)[1], train[on], ev[on]):
                    different = t[x] != t[y]
                    x, y = x[different], y[different]
                    close = (grid[row[x]] != grid[row[y]]).sum(axis=1) <= TYPOS
                    seen.append(np.unique(t[x[close]] * n + t[y[close]]))
            if heavy.any():
                on = heavy[bucket]
                t, p = text[on], place[on]
                texts = block.strings.take(pa.array(t)).to_pylist()
                key = [_signed(xxhash.xxh64_intdigest("|".join((x.split(" ") * 2)[q : q + int(arcs[w])]), (s * 31 + q) & (1 << 64) - 1)) for x, q, s in zip(texts, p.tolist(), block.speaker[t].tolist())]
                free = [sorted((q + k) % int(w) for k in range(int(arcs[w]), int(w))) for q in p.tolist()]
                put(1, t, key, block.cls[t].tolist(), texts, free)
        if seen:
            pairs = np.unique(np.concatenate(seen))
            x, y = pairs // n, pairs % n
            tx, ty = block.strings.take(pa.array(x)).to_pylist(), block.strings.take(pa.array(y)).to_pylist()
            same = np.array([same_words(p, q, TYPOS) for p, q in zip(tx, ty)], bool)
            put(0, x[same], block.cls[x[same]].tolist(), block.cls[y[same]].tolist())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_MEMBER = "bucket long, speaker long, class long, side int, text string, free array<int>"
_MEMBER_ARROW = pa.schema([("bucket", pa.int64()), ("speaker", pa.int64()), ("class", pa.int64()), ("side", pa.int32()), ("text", pa.string()), ("free", pa.list_(pa.int32()))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with many free places to three, each with the words of a third of those places in its bucket: if two texts
    differ in two words, one third agrees."""
    import xxhash

    for b in batches:
        rows: list[list] = [[] for _ in _MEMBER_ARROW]
        for bucket, speaker, cls, side, text, free in zip(*(b.column(c).to_pylist() for c in _MEMBER_ARROW.names)):
            words = text.split(" ")
            for k in range(TYPOS + 1):
                part = free[k :: TYPOS + 1]
                key = _signed(xxhash.xxh64_intdigest(f"{k}|" + "|".join(words[i] for i in part), bucket & (1 << 64) - 1))
                for c, v in zip(rows, (key, speaker, cls, side, text, [i for x, i in enumerate(free) if x % (TYPOS + 1) != k])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _MEMBER_ARROW)], schema=_MEMBER_ARROW)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members to (key, speaker, class, side)."""
    import xxhash

    for b in batches:
        rows: list[list] = [[], [], [], []]
        for bucket, speaker, cls, side, text, free in zip(*(b.column(c).to_pylist() for c in _MEMBER_ARROW.names)):
            for k in tolerant_keys(text.split(" "), free, side):
                for c, v in zip(rows, (_signed(xxhash.xxh64_intdigest(k, bucket & (1 << 64) - 1)), speaker, cls, side)):
                    c.append(v)
            if len(rows[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["key", "speaker", "class", "side"])
                rows = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["key", "speaker", "class", "side"])


def _sides(df: DataFrame, key: str) -> DataFrame:
    """(speaker, a, b): classes of both splits, not the same, that share a key."""
    a = df.where("(side & 1) != 0").select(key, "speaker", F.col("class").alias("a"))
    b = df.where("(side & 2) != 0").select(key, F.col("speaker").alias("_s"), F.col("class").alias("b"))
    return a.join(b, key).where("speaker = _s and a <> b").select("speaker", "a", "b")


def spelled_pairs(members: DataFrame) -> DataFrame:
    """(speaker, a, b) of the classes with the same words among the members of buckets (see _pairs_of)."""
    wide, narrow, near_ = members.where(F.size("free") > FREE), members.where(F.size("free") <= FREE), []
    while not wide.isEmpty():
        wide = staged(wide.mapInArrow(_cut, _MEMBER), "cut-members")
        n = wide.groupBy("bucket").agg(F.count_if("(side & 1) != 0").alias("na"), F.count_if("(side & 2) != 0").alias("nb")).where("na > 0 and nb > 0")
        wide = staged(wide.join(n, "bucket"), "cut-buckets")
        few = F.col("na") * F.col("nb") <= PAIRS * (F.col("na") + F.col("nb"))
        near_.append(_sides(wide.where(few), "bucket"))
        wide = wide.where(~few).drop("na", "nb")
        narrow, wide = narrow.unionByName(wide.where(F.size("free") <= FREE)), wide.where(F.size("free") > FREE)
    found = _sides(narrow.mapInArrow(_spelled, "key long, speaker long, class long, side int"), "key")
    for d in near_:
        found = found.unionByName(d)
    texts = members.groupBy("speaker", "class").agg(F.first("text").alias("text"))
    x = found.distinct().join(texts.select("speaker", F.col("class").alias("a"), F.col("text").alias("x")), ["speaker", "a"])
    x = x.join(texts.select("speaker", F.col("class").alias("b"), F.col("text").alias("y")), ["speaker", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            ok = [same_words(x, y, TYPOS) for x, y in zip(r.column("x").to_pylist(), r.column("y").to_pylist())]
            yield r.select(["speaker", "a", "b"]).filter(pa.array(ok, pa.bool_()))

    return x.select("speaker", "a", "b", "x", "y").mapInArrow(exact, "speaker long, a long, b long")


def _records(df: DataFrame, bits) -> DataFrame:
    """(utt_id, side, speaker, class, text) of the records with a speaker of the bitmap and a sentence; text is folded,
    class a hash of speaker and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            b = b.filter(pa.array(in_bitmap(bits.value, b.column("slot").to_numpy())))
            text = fold_array(b.column("sentence"))
            keep = pc.fill_null(pc.invert(pc.is_in(text, value_set=pa.array(NO_SENTENCE))), False)
            b, text = b.filter(keep), text.filter(keep)
            who = b.column("speaker").to_numpy()
            cls = np.fromiter((xxhash.xxh64_intdigest(t, s & (1 << 64) - 1) for t, s in zip(text.to_pylist(), who.tolist())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("utt_id"), b.column("side"), b.column("speaker"), pa.array(cls.astype(np.int64)), text], names=["utt_id", "side", "speaker", "class", "text"])

    return df.select("utt_id", "side", "sentence", "speaker", slot_of(F.col("speaker")).alias("slot")).where("speaker is not null and sentence is not null").mapInArrow(
        run, "utt_id long, side int, speaker long, class long, text string"
    )


def _both(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The staged records of both splits, those of training (side 1) only of speakers that evaluation (side 2) seems to
    have. The bitmap has a fixed size; with some millions of speakers and more it lets everything through."""
    key = speaker_key(F.col("client_id"))
    cols = ["utt_id", "sentence", F.xxhash64(key).alias("speaker"), key.isNotNull().alias("known")]
    both = train.select(*cols, F.lit(1).alias("side")).unionByName(evaluation.select(*cols, F.lit(2).alias("side"))).where("known")
    asked = train.sparkSession.sparkContext.broadcast(bitmap(evaluation.select(*cols).where("known"), "speaker"))
    return staged(_records(both, asked), "overlap-records")


def text_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id) of records of one speaker whose sentences have the same words."""
    records = _both(train, evaluation)
    found = staged(suffix_arrays(records.select("speaker", "class", "side", "text"), _pairs_of, _FOUND, width(train), True), "overlap-array")
    same = found.where("kind = 0").select("speaker", "a", "b")
    members = found.where("kind = 1").select(F.col("a").alias("bucket"), "speaker", F.col("b").alias("class"), "side", "text", "free")
    if not members.isEmpty():
        same = same.unionByName(spelled_pairs(members))
    same = same.distinct()
    ta = records.where("side = 1").select("speaker", F.col("class").alias("a"), F.col("utt_id").alias("train_id"))
    tb = records.where("side = 2").select("speaker", F.col("class").alias("b"), F.col("utt_id").alias("eval_id"))
    return same.join(tb, ["speaker", "b"]).join(ta, ["speaker", "a"]).select("train_id", "eval_id")


_SPANS = pa.schema([("speaker", pa.int64()), ("class", pa.int64()), ("words", pa.int32()), ("covered", pa.list_(pa.int32()))])


def _spans_of(block: _Block) -> pa.RecordBatch:
    """(speaker, class, words, covered): the places of a text that lie in spans which a training text has too."""
    keep = block.both_sides()
    lengths = np.where(keep, block.lengths, 0)
    rows: list[list] = [[] for _ in _SPANS]
    if lengths.any():
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        sa = SuffixArray(block.codes[np.repeat(keep, block.lengths)], offsets, block.group, SPAN, False)
        order, common = sa.sorted(np.flatnonzero(sa.place < lengths[sa.text]))
        text, place = sa.text[order], sa.place[order]
        left = lengths[text] - place
        train, ev = (block.side[text] & 1) != 0, (block.side[text] & 2) != 0
        for c in range(1, SPAN + 1):
            # a text shorter than a span is one itself
            mine = ev & ((left >= SPAN) if c == SPAN else (place == 0) & (lengths[text] == c))
            if not mine.any():
                continue
            run = np.cumsum(common < c)
            has = np.bincount(run, train & (left >= c)) > 0
            hit = np.flatnonzero(mine & has[run])
            split = block.bins[text[hit]] > 1
            if split.any():
                s = hit[split]
                split[split] = _bin_of(block, text[s], place[s], np.full(len(s), c), False) != block.bin[text[s]]
                hit = hit[~split]
            hit = hit[np.lexsort((place[hit], text[hit]))]
            which, first = np.unique(text[hit], return_index=True)
            for t, at in zip(which.tolist(), np.split(place[hit], first[1:])):
                merged = np.unique((at[:, None] + np.arange(c)).ravel())
                for col, v in zip(rows, (int(block.speaker[t]), int(block.cls[t]), int(lengths[t]), merged.tolist())):
                    col.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SPANS)], schema=_SPANS)


def span_coverage(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(utt_id, words, covered): how many words of each evaluation record lie in spans of SPAN words or more that some
    training text of its speaker has too, wherever it has them. A shorter text is covered as a whole or not at all.
    Records without a speaker or sentence, or with no shared span, give no row; overlapping spans are merged."""
    records = _both(train, evaluation)
    schema = "speaker long, class long, words int, covered array<int>"
    found = suffix_arrays(records.select("speaker", "class", "side", "text"), _spans_of, schema, width(train), False)
    covered = found.groupBy("speaker", "class", "words").agg(F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"))
    return records.where("side = 2").select("speaker", "class", "utt_id").join(covered, ["speaker", "class"]).select("utt_id", "words", "covered")


def file_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id) of records whose audio_path names the same file in the same dataset."""
    a = train.select(F.col("utt_id").alias("train_id"), "dataset", file_key(F.col("audio_path")).alias("file")).where("file is not null")
    b = evaluation.select(F.col("utt_id").alias("eval_id"), "dataset", file_key(F.col("audio_path")).alias("file")).where("file is not null")
    return a.join(b, ["dataset", "file"]).select("train_id", "eval_id")


def cross_split_pairs(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(train_id, eval_id), once each, of a training and an evaluation record of the same recording.

    The same recording: audio_path names the same file in the same dataset, or one speaker (by the digits of client_id)
    says the same words (see functions.text.same_words). A missing path, dataset, speaker or sentence matches nothing.
    Records delivered twice are paired each; empty tables give no rows; columns other than those named are ignored."""
    return text_pairs(train, evaluation).unionByName(file_pairs(train, evaluation)).distinct()
