"""Periodic runs of words: where a text repeats itself back to back, and the text with every run told once.

A run is a stretch of words with smallest period q, at least ``MIN_WORDS`` and two periods long, that its neighbours do not
extend. Runs come from queries for inner patterns. A run of period p holds an aligned block of 2^k words, 2^k <= (p+1)/2,
in its first period, and the block comes again p words on. So for each dyadic block the occurrences in the neighbouring window
are asked for: they stand in an interval of the suffix array, and a wavelet matrix over that array answers range successor,
how many lie in the window and which. Three or more in a window as long as the block form one arithmetic progression; its
members are candidate periods, unless block and progression lie in one run of a shorter period. Candidates are extended
to both sides by comparing names of blocks, and the smallest period of an interval stays.

All texts of an Arrow batch are worked on together, with numpy. Names of blocks hold their document, so nothing meets
across documents; suffixes whose first four words do not come again in their document are left out of the array: no block
of four words or more can recur there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import PLAIN, append, texts, words

#: Fewest words of a run. With blocks of four words at every second word this is enough to find the periods 1 to 7.
MIN_WORDS = 12
#: Words of the shortest block.
BLOCK = 4
#: Block queries answered together.
QUERIES = 1 << 19
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WaveletMatrix:
    """Order statistics of any interval of a sequence of numbers below 2^bits."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.n, self.bits, self.zeros, self.below = n, max(1, n.bit_length()), [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            ranks = np.zeros(n + 1, np.int32)
            np.cumsum(one == 0, out=ranks[1:])
            self.below.append(ranks)
            self.zeros.append(int(ranks[n]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of each interval [low, high) are less than ``bound``."""
        found = np.zeros(len(low), np.int64)
        for at, (ranks, zeros) in enumerate(zip(self.below, self.zeros)):
            one = ((bound >> (self.bits - 1 - at)) & 1).astype(bool)
            l0, h0 = ranks[low], ranks[high]
            found += np.where(one, h0 - l0, 0)
            low, high = np.where(one, zeros + low - l0, l0), np.where(one, zeros + high - h0, h0)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest, from 0, of each interval [low, high)."""
        value = np.zeros(len(low), np.int64)
        for at, (ranks, zeros) in enumerate(zip(self.below, self.zeros)):
            l0, h0 = ranks[low], ranks[high]
            one = k >= h0 - l0
            k = np.where(one, k - (h0 - l0), k)
            value += np.where(one, 1 << (self.bits - 1 - at), 0)
            low, high = np.where(one, zeros + low - l0, l0), np.where(one, zeros + high - h0, h0)
        return value


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Blocks:
    """Names of the recurring blocks of 4, 8, 16, ... words of many documents, and the sparse suffix array under them.

    ``codes`` numbers the words of all documents in a row; ``starts`` and ``ends`` give each word's document.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        n = len(codes)
        self.codes, self.starts, self.ends = codes, starts, ends
        self.places = self._recurring()
        self.rank_of = np.full(n + 1, -1, np.int64)
        self.rank_of[self.places] = np.arange(len(self.places))
        #: For each size of block: name of the block at each place (its first slot in the suffix array), and how many share it.
        self.names: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.order = np.arange(len(self.places))
        if len(self.places):
            self._double()

    def _recurring(self) -> np.ndarray:
        """Places whose four words come again in the document: by hashes first, then exactly."""
        codes, n = self.codes, len(self.codes)
        place = np.flatnonzero(np.arange(n) + BLOCK <= self.ends) if n else np.empty(0, np.int64)
        if not len(place):
            return place
        mixed = self.starts[place].astype(np.uint64) * _MIX[4]
        for k in range(BLOCK):
            mixed = (mixed ^ codes[place + k].astype(np.uint64)) * _MIX[k]
            mixed ^= mixed >> np.uint64(29)
        ordered = np.sort(mixed)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return place[:0]
        at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
        place = place[twice[at] == mixed]
        order, first = self._ordered_words(place)
        bounds = np.flatnonzero(np.append(first, True))
        alone = np.repeat(np.diff(bounds) == 1, np.diff(bounds))
        return np.sort(place[order[~alone]])

    def _ordered_words(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the places by document and four words, and which of them begins a group of equals."""
        wide = int(self.codes.max()) + 1
        pairs = [self.codes[place + k].astype(np.int64) * wide + self.codes[place + k + 1] for k in (0, 2)]
        document = self.starts[place]
        order = np.lexsort((pairs[1], pairs[0], document))
        first = np.ones(len(place), bool)
        first[1:] = False
        for key in (document, *pairs):
            key = key[order]
            first[1:] |= key[1:] != key[:-1]
        return order, first

    def _named(self, first: np.ndarray, slots: np.ndarray, order: np.ndarray, name: np.ndarray, size: np.ndarray) -> None:
        """Write the names and sizes of groups of ``order``, which stands in ``slots``."""
        bounds = np.flatnonzero(first)
        counts = np.diff(np.append(bounds, len(first)))
        name[order] = np.repeat(slots[bounds], counts)
        size[order] = np.repeat(counts, counts)

    def _double(self) -> None:
        m, n, places = len(self.places), len(self.codes), self.places
        self.order, first = self._ordered_words(places)
        name, size = np.empty(m, np.int64), np.empty(m, np.int64)
        self._named(first, np.arange(m), self.order, name, size)
        length = BLOCK
        while True:
            self.names.append(name)
            self.sizes.append(size)
            slots = np.flatnonzero(size[self.order] > 1)
            if not len(slots):
                return
            group = self.order[slots]
            place = places[group]
            after = np.minimum(place + length, n)
            rank = self.rank_of[after]
            # What follows: the name of the next block, or a name of one's own where that does not recur or does not fit.
            follows = np.where(place + 2 * length > self.ends[place], m + place, np.where(rank >= 0, name[rank], m + after))
            key = name[group] * (m + n + 1) + follows
            sort = np.argsort(key, kind="stable")
            key, group = key[sort], group[sort]
            first = np.ones(len(group), bool)
            first[1:] = key[1:] != key[:-1]
            name, size = name.copy(), size.copy()
            self.order[slots] = group
            self._named(first, slots, group, name, size)
            length *= 2

    def _same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank_of[i], self.rank_of[j]
        return (a >= 0) & (b >= 0) & (self.names[level][a] == self.names[level][b])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j > i on, in the document."""
        n, at = len(self.codes), np.zeros(len(i), np.int64)
        end = self.ends[j]
        for level in range(len(self.names) - 1, -1, -1):
            fits = j + at < end
            same = fits & self._same(level, np.where(fits, i + at, n), np.where(fits, j + at, n))
            at += np.where(same, BLOCK << level, 0)
        open_ = np.ones(len(i), bool)
        for _ in range(BLOCK - 1):
            open_ &= j + at < end
            open_ &= self.codes[np.where(open_, i + at, 0)] == self.codes[np.where(open_, j + at, 0)]
            at += open_
        return at

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j > i, in the document."""
        n, at = len(self.codes), np.zeros(len(i), np.int64)
        start = self.starts[i]
        for level in range(len(self.names) - 1, -1, -1):
            back = at + (BLOCK << level)
            fits = i - back >= start
            same = fits & self._same(level, np.where(fits, i - back, n), np.where(fits, j - back, n))
            at += np.where(same, BLOCK << level, 0)
        open_ = np.ones(len(i), bool)
        for _ in range(BLOCK - 1):
            open_ &= i - at - 1 >= start
            open_ &= self.codes[np.where(open_, i - at - 1, 0)] == self.codes[np.where(open_, j - at - 1, 0)]
            at += open_
        return at


def find_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, ordered by start and period; places count over all documents."""
    blocks = Blocks(codes, starts, ends)
    none = np.empty(0, np.int64)
    if not len(blocks.places):
        return none, none, none
    array = WaveletMatrix(blocks.order)
    found = [(none, none, none)]
    for level, (name, size) in enumerate(zip(blocks.names, blocks.sizes)):
        length = BLOCK << level
        aligned = (blocks.places - starts[blocks.places]) % length == 0
        half = (blocks.places - starts[blocks.places]) % 2 == 0
        windows = [(aligned, 2 * length - 1, 3 * length - 2), (aligned, 3 * length - 1, 4 * length - 2)]
        if not level:
            windows += [(half, 1, BLOCK), (half, BLOCK + 1, 2 * BLOCK - 2)]
        for stands, nearest, farthest in windows:
            asked = np.flatnonzero(stands & (size > 1))
            for at in range(0, len(asked), QUERIES):
                i, d = _periods(blocks, array, asked[at:at + QUERIES], name, size, length, nearest, farthest)
                j = i + d
                low, high = i - blocks.backward(i, j), j + blocks.forward(i, j)
                long = high - low >= np.maximum(MIN_WORDS, 2 * d)
                found.append(_smallest(low[long], high[long], d[long]))
    low, high, period = _smallest(*(np.concatenate(x) for x in zip(*found)))
    order = np.lexsort((period, low))
    return low[order], high[order], period[order]


def _periods(blocks: Blocks, array: WaveletMatrix, asked, name, size, length: int, nearest: int, farthest: int):
    """Candidates (place, distance) of blocks: where they occur again, from ``nearest`` to ``farthest`` words on."""
    place, low = blocks.places[asked], name[asked]
    high = low + size[asked]
    below = array.less(low, high, np.searchsorted(blocks.places, place + nearest))
    count = array.less(low, high, np.searchsorted(blocks.places, place + farthest + 1)) - below
    hit = count > 0
    place, low, high, below, count = place[hit], low[hit], high[hit], below[hit], count[hit]
    first = blocks.places[array.nth(low, high, below)]
    step = np.zeros(len(place), np.int64)
    more = count > 1
    step[more] = blocks.places[array.nth(low[more], high[more], below[more] + 1)] - first[more]
    # Three or more are a progression, its step a period of the block. A block that runs on with it to the first of them is in the same run.
    many = np.flatnonzero(count > 2)
    reach = place[many] + step[many] + blocks.forward(place[many], place[many] + step[many])
    keep = np.ones(len(place), bool)
    keep[many[reach >= first[many] + length]] = False
    place, first, step, count = place[keep], first[keep], step[keep], count[keep]
    nth = _spread(np.zeros(len(place), np.int64), count)
    return np.repeat(place, count), np.repeat(first - place, count) + nth * np.repeat(step, count)


def _smallest(low: np.ndarray, high: np.ndarray, period: np.ndarray):
    """Each interval once, with its smallest period."""
    order = np.lexsort((period, high, low))
    low, high, period = low[order], high[order], period[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[first], high[first], period[first]


def runs_of_texts(rows: list) -> tuple[np.ndarray, list, list[str]]:
    """For each text, where its runs begin in the list, the runs (start, length, period), and the text without repetitions."""
    found = [words(text, PLAIN) for text in rows]
    counts = np.array([len(x) for x in found], np.int64)
    ends_of = np.cumsum(counts)
    flat = [w for x in found for w in x]
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends = np.repeat(ends_of - counts, counts), np.repeat(ends_of, counts)
    low, high, period = find_runs(codes, starts, ends)
    edges = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edges, low + period, 1)
    np.add.at(edges, high, -1)
    gone = np.cumsum(edges)[:-1] > 0
    begins = np.searchsorted(low, np.append(0, ends_of))
    collapsed = []
    for x, n, end, a, b in zip(found, counts, ends_of, begins, begins[1:]):
        kept = x if a == b else [w for w, out in zip(x, gone[end - n:end].tolist()) if not out]
        collapsed.append(b" ".join(kept).decode())
    return begins, [low - starts[low] if len(low) else low, high - low, period], collapsed


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` array<struct<start, length, period>> and ``collapsed``.

    Words are separated by white space of ASCII and numbered from 0; a run has at least ``MIN_WORDS`` words and two smallest
    periods, and cannot be extended. Runs are ordered by start, then period. ``collapsed`` holds the words that no run contains
    after its first period, joined by one blank. Null, empty and blank texts have no runs and an empty ``collapsed``. Texts
    of any length are worked on whole, in one task; equal rows get equal results. Columns of these names are replaced.
    No shuffle; memory grows with an Arrow batch, about 100 bytes a word.
    """

    def start():
        def batch(rows):
            begins, runs, collapsed = runs_of_texts(texts(rows, text))
            each = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs], ["start", "length", "period"])
            return [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), each), collapsed]

        return batch

    made = "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return append(docs, made, start, needs=[text] if text in ("runs", "collapsed") else [])


def op13_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, of which one in ten gets a period first. Null texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    found = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.where(h % 10 == 0).withColumn("words", found).withColumn("n", F.size("words")).where("n > 0")
    a = (g % F.col("n")).cast("int")
    planted = planted.withColumn("a", a).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    planted = planted.select("doc_id", F.array_join(repeated, " ").alias("text"))
    plain = docs.where((h % 10 != 0) | h.isNull() | F.col("text").isNull() | (F.size(found) == 0))
    done = collapse_runs(plain.union(planted))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    done = done.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
