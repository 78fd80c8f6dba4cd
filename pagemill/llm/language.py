"""Language of texts by n-gram filters whose bits are languages.

A Bloom filter for each language, stored bit-sliced: one table whose entry at a position has a bit for every
language. The bits common to an n-gram's positions are all languages that hold the n-gram, in one lookup. A text's
n-grams are counted per language, the share that false positives alone would give is taken off, and the
language with the largest share decides.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import append, bound_batches, checkpoint, texts

#: Labelled texts per language that a model learns from, about: those with the smallest hashes of their keys.
LEARN_TEXTS = 5000
#: An n-gram is one of a language if it makes up this share of the language's n-grams, and LEAST_RATIO of the share that it has in the language where it is most frequent.
LEAST_SHARE, LEAST_RATIO = 1e-5, 0.3
#: n-grams of so many letters; a word has a blank on either side.
LENGTHS = (3, 4)
#: Positions of an n-gram in the table.
HASHES = 4
MOST_LANGUAGES = 64
UNKNOWN = "und"

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's lower-cased words, repeats included; empty without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    blank = points == 32
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]  # one blank after each word
    points = points[keep].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.uint64)
    blank = points == 32
    out = []
    for n in LENGTHS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        mixed = np.full(count, n, np.uint64)
        inner = np.zeros(count, bool)
        for i in range(n):
            mixed += points[i : i + count] * _ODD[i]
            if 0 < i < n - 1:
                inner |= blank[i : i + count]
        mixed = mixed[~inner]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return np.concatenate(out)


def positions(hashes: np.ndarray, size: int, i: int) -> np.ndarray:
    """The i-th position of n-grams in a table of ``size`` entries, a power of two."""
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return ((hashes + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64)


class Filters:
    """Bit-sliced filters of several languages."""

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: np.ndarray) -> None:
        """``masks`` has the languages of each of ``hashes`` as bits."""
        self.languages = languages
        self.width = max(1, -(-len(languages) // 8))
        most = max([1, *(int(np.count_nonzero(masks >> np.uint64(i) & np.uint64(1))) for i in range(len(languages)))])
        self.size = 1 << max(10, (most * HASHES * 2 - 1).bit_length())
        table = np.zeros(self.size, np.uint64)
        for i in range(HASHES):
            np.bitwise_or.at(table, positions(hashes, self.size, i), masks)
        filled = self._counts(table) / self.size
        self.false = filled**HASHES
        self.table = table if self.width > 4 else table.astype(np.uint32 if self.width > 2 else np.uint16 if self.width > 1 else np.uint8)

    def _counts(self, masks: np.ndarray) -> np.ndarray:
        """How many masks have each language's bit."""
        return np.array([np.count_nonzero(masks & masks.dtype.type(1 << i)) for i in range(len(self.languages))], np.float64)

    def holding(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of the languages that hold each n-gram."""
        found = self.table[positions(hashes, self.size, 0)]
        for i in range(1, HASHES):
            found &= self.table[positions(hashes, self.size, i)]
        return found

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language holds, without what false positives give."""
        seen = self._counts(self.holding(hashes)) / len(hashes)
        return np.clip((seen - self.false) / (1 - self.false), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(found)
        best = int(np.argmax(shares))
        total = float(shares.sum())
        return self.languages[best], float(shares[best]) / total if total > 0 else 0.0


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters from the rows whose lang is not null, about ``LEARN_TEXTS`` whole texts of each language.

    Languages are ordered by their number of rows, then by name: the order decides ties. Counts of n-grams are made
    in the tasks and summed by Spark; to the driver come the n-grams that a language holds, at most 1 / LEAST_SHARE
    of each. Texts without letters and null texts teach nothing; no rows give filters without languages.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Filters([], np.empty(0, np.uint64), np.empty(0, np.uint64))
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    # Hashes of keys are spread evenly: the share below a bound is known before.
    chosen = F.lit(False)
    number = F.lit(None).cast("int")
    for i, name in enumerate(languages):
        bound = min(1.0, LEARN_TEXTS / sizes[name])
        chosen = chosen | ((F.col("lang") == name) & (F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(bound * 1_000_000)))
        number = F.when(F.col("lang") == name, i).otherwise(number)
    some = rows.where(chosen).select(number.alias("lang"), "text")

    def count(batches):
        for batch in batches:
            found: dict[int, list] = {}
            for at, body in zip(batch.column("lang").to_pylist(), texts(batch)):
                found.setdefault(at, []).append(grams(body))
            for at, parts in found.items():
                hashes, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), at, np.int32)), pa.array(times.astype(np.int64))], names=["gram", "lang", "times"])

    counted = some.mapInArrow(count, "gram long, lang int, times long").groupBy("gram").agg(
        *[F.sum(F.when(F.col("lang") == i, F.col("times")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))])
    counted = checkpoint(counted)
    totals = counted.agg(*[F.sum(f"n{i}") for i in range(len(languages))]).first()
    share = [F.col(f"n{i}") / F.lit(max(1, totals[i] or 0)) for i in range(len(languages))]
    top = F.greatest(*share, F.lit(0.0))
    mask = F.lit(0).cast("long")
    for i, s in enumerate(share):
        bit = F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")
        mask = mask.bitwiseOR(F.when((s >= LEAST_SHARE) & (s >= top * LEAST_RATIO) & (F.col(f"n{i}") > 1), bit).otherwise(F.lit(0).cast("long")))
    held = counted.select("gram", mask.alias("mask")).where("mask <> 0").toArrow()
    return Filters(languages, held.column("gram").to_numpy().view(np.uint64), held.column("mask").to_numpy().view(np.uint64))


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score: the language that holds most of the text's n-grams and its part of all shares.

    Null texts and texts without a letter get ``UNKNOWN`` and 0; a text of whose n-grams no language holds any gets
    the first language and 0. Whole texts; columns with the new names are replaced. No shuffle. The table that is
    sent has at most 16 x HASHES / LEAST_SHARE entries of up to 8 bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def start():
        model = sent.value

        def batch(rows):
            found = [model.decide(t) for t in texts(rows, text)]
            return [[f[0] for f in found], [f[1] for f in found]]

        return batch

    return append(docs, "lang_pred string, score double", start)


def remainder(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4))


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = learn(docs.where(remainder() != 2).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
