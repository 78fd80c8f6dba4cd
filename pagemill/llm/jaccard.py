"""N-gram Jaccard join: which texts share so many word n-grams that they count as one.

A size-aware join. A text's set holds its distinct word shingles. Sets of equal elements fall together first.
Of the rest,

* small sets list all subsets of the sizes that a link to another small set would need; sets that list the
  same subset are candidates;
* large sets are found by scanning inverted lists. An element order that puts elements of a single set first
  lets each set stand in the lists of its first elements only: a linked pair always meets in one of them.

The boundary is the size at which the rows of both ways together are fewest, from the counts of sizes and the
measured length of lists. In each list of candidates a central set is compared with all others, linked sets fall
together, and then the sets that stayed apart are compared with the rest, unless the parities of their elements
show that they differ too much. A list is done when its sets are together or all have been compared. So a group
of copies costs about one comparison a member, yet no link between two components is missed.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import LOWER, append, checkpoint, few, settled, stored, texts, words
from pagemill.llm.components import components

#: Sets above this size are never listed by subsets; up to it the cost decides.
SUBSET_SIZES = 40
#: Words of 64 bits in a set's parity: bit k tells whether an odd number of its elements falls to k. Two sets differ in
#: at least as many elements as their parities differ in bits.
PARITY = 8
#: A screened list holds one element more for each so many elements of its set, and a set goes on if that many are shared.
EXTRA = 20

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; fewer words make one shingle."""
    found = words(text, LOWER)
    if not found:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    span = min(size, len(found))
    out = np.full(len(found) - span + 1, span, np.uint64)
    for i in range(span):
        out = _mixed(out * _ODD[i % 4] + hashed[i : len(hashed) - span + 1 + i])
    return np.unique(out.view(np.int64))


class Threshold:
    """``percent`` of 100: sets link when 100 * intersection >= percent * union."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def overlap(self, n: int, m: int) -> int:
        """Elements that sets of n and m must share to link."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least(self, n: int) -> int:
        """Elements that a set of n must share with whatever links to it: also the size of its smallest partner."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def overlap_of(self, n: Column, m: Column) -> Column:
        return F.ceil(F.lit(self.percent) * (n + m) / F.lit(100 + self.percent))

    def subset_sizes(self, n: int, most: int) -> list[int]:
        """Sizes of common subsets by which a set of n finds its partners of at most ``most`` elements."""
        return sorted({self.overlap(n, m) for m in range(self.least(n), min(most, 100 * n // self.percent) + 1)})


def _sets(docs: DataFrame, text: str, size: int, law: Threshold, whole: bool) -> DataFrame:
    """``docs`` without the text, with digest, n, parity and keys: the whole sorted set, or of a large one the screened beginning."""

    def start():
        def batch(rows):
            found = [shingles(t, size) for t in texts(rows, text)]
            ids = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in found]
            counts = [len(s) for s in found]
            if not whole:
                found = [s if len(s) <= SUBSET_SIZES else s[: law.prefix(len(s)) + len(s) // EXTRA] for s in found]
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32), pa.int32())
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            parity = zip(*map(_parity, found)) if whole and found else [[0] * len(found)] * PARITY
            return [ids, counts, pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64())), *map(list, parity)]

        return batch

    return append(docs, f"digest long, n long, keys array<long>, {', '.join(f'{c} long' for c in _PARITIES)}", start).drop(text, *[] if whole else _PARITIES)


_PARITIES = [f"odd{i}" for i in range(PARITY)]


def _parity(keys: np.ndarray) -> list[int]:
    odd = np.bincount((keys & (64 * PARITY - 1)), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _boundary(unique: DataFrame, law: Threshold) -> int:
    """The size up to which sets are listed by subsets: fewest rows in all. Reads sizes and lists of small sets only."""
    small = unique.where(F.col("n") <= SUBSET_SIZES)
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    if not sizes:
        return 0
    length = small.select(F.explode(F.slice("keys", F.lit(1), (F.col("n") - F.ceil(F.col("n") * law.percent / 100) + 1).cast("int"))).alias("h"))
    lists = length.groupBy("h").count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0]

    def rows(most: int) -> float:
        subsets = sum(c * sum(math.comb(n, k) for k in law.subset_sizes(n, most)) for n, c in sizes.items() if n <= most)
        return subsets + sum(c * law.prefix(n) * (1 + lists) for n, c in sizes.items() if n > most)

    return min(range(SUBSET_SIZES + 1), key=rows)


def _subsets(unique: DataFrame, most: int, law: Threshold) -> DataFrame:
    """(h, set_id): the subsets of small sets, hashed, where another set lists them too."""

    def start():
        def batch(rows):
            out = []
            for n, keys in zip(rows.column("n").to_pylist(), rows.column("keys").to_pylist()):
                out.append([
                    xxhash.xxh64_intdigest(np.array(some, np.int64).tobytes(), seed=k) - (1 << 63)
                    for k in law.subset_sizes(n, most) for some in itertools.combinations(keys, k)
                ])
            return [out]

        return batch

    listed = append(unique.where(F.col("n") <= most).select("set_id", "n", "keys"), "subsets array<long>", start)
    return _shared(listed.select(F.explode("subsets").alias("h"), "set_id"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (h, set_id) whose h stands in another set too. Both sides of the join are one shuffle, and adaptive execution splits hot values."""
    here, there = rows.alias("here"), rows.alias("there")
    other = (F.col("here.h") == F.col("there.h")) & (F.col("here.set_id") != F.col("there.set_id"))
    return here.join(there, other, "left_semi")


def _screened(unique: DataFrame, most: int, law: Threshold) -> DataFrame:
    """Ids of large sets, and of small ones near the boundary, that share enough of their beginning with others.

    Linked sets share at least as many elements of both beginnings as the smaller one has extra ones.
    """
    begun = unique.where(F.col("n") >= law.least(most + 1))
    length = (F.col("n") - F.ceil(F.col("n") * law.percent / 100) + 1 + F.floor(F.col("n") / EXTRA)).cast("int")
    rows = begun.select(F.explode(F.slice("keys", F.lit(1), length)).alias("h"), "set_id")
    counts = _shared(rows).groupBy("set_id").count()
    need = 1 + F.floor(F.ceil(F.col("n") * law.percent / 100) / EXTRA)
    return begun.select("set_id", "n").join(counts, "set_id").where(F.col("count") >= need).select("set_id")


def _lists(sets: DataFrame, law: Threshold) -> DataFrame:
    """(h, set_id, at) of large sets: the lists of their first elements, elements of a single set first, ``at`` the place."""
    rows = _shared(sets.select(F.explode("keys").alias("h"), "set_id"))
    found = rows.groupBy("set_id").agg(F.count("*").alias("m"), F.sort_array(F.collect_list("h")).alias("hs"))
    alone = F.col("n") - F.col("m")
    left = F.col("n") - F.ceil(F.col("n") * law.percent / 100) + 1 - alone
    first = found.join(sets.select("set_id", "n"), "set_id").where(left > 0)
    return first.select(F.posexplode(F.slice("hs", F.lit(1), left.cast("int"))).alias("i", "h"), "set_id", alone.alias("alone")).select(
        "h", "set_id", (F.col("alone") + F.col("i")).alias("at"))


def _open(lists: DataFrame) -> DataFrame:
    """Lists that hold sets of more than one label."""
    mixed = lists.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    return lists.join(mixed, "h", "left_semi")


def _joined(lists: DataFrame, sets: DataFrame, law: Threshold) -> DataFrame:
    """(node, label) of the sets that link to others, from the candidate lists (h, set_id, at).

    Round by round: in each open list the most central set, later the sets whose label is rarest in the list, are pivots;
    each is compared with all sets of other labels that it may link to, by place and parity, and leaves the list.
    """
    spark = lists.sparkSession
    lists = lists.join(sets.drop("keys"), "set_id").withColumn("label", F.col("set_id"))
    lists = settled(_open(lists))
    labels = spark.createDataFrame([], "node long, label long")
    tested = spark.createDataFrame([], "a long, b long")
    pivots_each = 1
    while not lists.isEmpty():
        counted = lists.groupBy("h", "label").agg(F.count("*").alias("alike"))
        place = F.row_number().over(Window.partitionBy("h").orderBy("alike", "at", "set_id"))
        pivots = settled(lists.join(counted, ["h", "label"]).withColumn("place", place).where(F.col("place") <= pivots_each).drop("place", "alike"))
        p = pivots.select(*[F.col(c).alias(f"p_{c}") for c in pivots.columns])
        need = law.overlap_of(F.col("n"), F.col("p_n"))
        differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in _PARITIES), F.lit(0))
        fit = (F.col("n") - F.col("at") >= need) & (F.col("p_n") - F.col("p_at") >= need) & (differ <= F.col("n") + F.col("p_n") - 2 * need)
        pairs = lists.join(p, (F.col("h") == F.col("p_h")) & (F.col("label") != F.col("p_label")) & fit)
        pairs = pairs.select(F.least("set_id", "p_set_id").alias("a"), F.greatest("set_id", "p_set_id").alias("b")).distinct()
        pairs = settled(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        labels = settled(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(_linked(pairs, sets, law))))
        rest = lists.drop("label").join(pivots.select("h", "set_id"), ["h", "set_id"], "left_anti")
        rest = rest.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        lists = settled(_open(rest.select(*lists.columns)))
        pivots_each *= 4096
    return labels


def _linked(pairs: DataFrame, sets: DataFrame, law: Threshold) -> DataFrame:
    """Pairs (a, b) whose whole sets link. Where pairs are few they are sent to the sets, of which only the wanted ones move."""
    some = few(pairs)
    first = sets.select(F.col("set_id").alias("a"), F.col("keys").alias("a_keys")).join(some, "a")
    second = sets.select(F.col("set_id").alias("b"), F.col("keys").alias("b_keys")).join(some.select("b"), "b", "left_semi")
    both = first.join(second, "b")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    return both.where(100 * shared >= law.percent * (F.size("a_keys") + F.size("b_keys") - shared)).select("a", "b")


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row of ``docs``: component_id is the smallest key reachable by links.

    Rows without words have an empty set, link with nothing and are their own component. Equal sets (also repeated
    rows) always link. A null key is never a component's name unless its component has no other. Other columns are
    not read. Hashes have 64 bits: of s different sets, some pair is taken as equal with a chance of s * s / 2**65.
    """
    law = Threshold(percent)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    base = stored(_sets(source, "body", size, law, False).withColumn("row", F.monotonically_increasing_id()))
    full = base.where("n > 0")
    # A set goes by the number of the first row that has it: shorter than its digest where many are moved.
    unique_ids = stored(full.groupBy("digest").agg(F.min("key").alias("least"), F.min(F.struct("row", "key")).alias("kept")).select("digest", "least", "kept.row", "kept.key"))
    unique = full.join(few(unique_ids.select("row")), "row", "left_semi").select(F.col("row").alias("set_id"), "n", "keys")
    most = _boundary(unique, law)
    small = settled(_subsets(unique, most, law))
    large_ids = settled(_screened(unique, most, law))
    wanted = large_ids.withColumn("large", F.lit(True)).union(small.select("set_id", F.lit(False))).groupBy("set_id").agg(F.max("large").alias("large"))
    wanted = settled(wanted.join(unique_ids.select("digest", F.col("row").alias("set_id"), "key"), "set_id"))
    sets = stored(_sets(_holders(source, wanted), "body", size, law, True).join(few(wanted.select("digest", "set_id", "large")), "digest").drop("digest", "key"))
    if sets.count() > wanted.count():  # keys that stand in several rows
        sets = stored(sets.groupBy("set_id").agg(*[F.first(c).alias(c) for c in sets.columns if c != "set_id"]))
    lists = small.select("h", "set_id", F.lit(0).cast("long").alias("at")).union(_lists(sets.where("large"), law))
    labels = _joined(lists, sets.drop("large"), law)
    named = unique_ids.select("digest", F.col("row").alias("set_id"), "least").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = checkpoint(named.select("digest", "least", F.coalesce("label", "set_id").alias("label")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    member = named.join(least, "label").select("digest", "component_id")
    own = [F.col("key").alias(key), F.col("n").alias("n_shingles")]
    joined = full.join(member, "digest").select(*own, "component_id")
    return joined.union(base.where("n = 0").select(*own, F.col("key").alias("component_id")))


def _holders(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` whose key is a wanted one, null keys too."""
    keys = few(settled(wanted.select(F.col("key").alias("wanted_key")).distinct()))
    return source.join(keys, source["key"].eqNullSafe(keys["wanted_key"]), "left_semi")


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
