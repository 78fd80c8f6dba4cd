"""A hierarchical Pitman-Yor language model of word pairs, learned and applied over the whole corpus.

Every word is a context, a restaurant whose customers are the words that follow it; all context restaurants share one parent, the
restaurant of single words, over a uniform base of all words and one unknown. Customers sit by the Chinese-restaurant process:
at a table of their word in proportion to its customers less a discount, or at a new table, which sends a customer to the parent.
Gibbs moves take a customer up and seat it again; tables are averaged over sweeps, and with them the predictive
probabilities, which are linear in them.

The work is dealt by hash of the context:

1. Texts become chunks of a few million tokens: distinct pairs, how often each is in training texts, and the texts that hold it.
2. Each bucket of contexts gathers its pairs of all chunks and seats them, with its own share of contexts as a first parent. Each word's tables go to a shard of the parent.
3. Each shard of the parent seats them and returns the probability of each word to the buckets that asked.
4. The buckets seat their pairs again under this parent, average, and return for each chunk what its texts' tokens add up to.

A pair that comes in many texts is one row a chunk. A context with too many customers for one bucket is dealt over
several by the word that follows; its tables are then counted over all of them between the two seatings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from pagemill.llm.common import LOWER, bound_batches, stored, texts, words

#: Tokens of a chunk, pairs of all chunks in a bucket.
CHUNK_TOKENS, BUCKET_PAIRS = 3_000_000, 1_000_000
#: A context with more than this part of a bucket's mean tokens is dealt over several.
HOT_PART = 0.5
#: Concentration of all restaurants.
CONCENTRATION = 1.0
#: Sweeps before tables are counted, sweeps that are averaged, and customers of a word that a sweep moves at most: these are drawn anew in each.
WARM_SWEEPS, SWEEPS, MOVES = 3, 4, 8
#: The context in which a text begins, and the word that ends it; other words have their hashes.
BEGIN, END = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)


# Arrays as bytes


def pack(values: np.ndarray) -> bytes:
    """Numbers without sign in the narrowest of 1, 2, 4 or 8 bytes, or floating-point numbers: compressed, all first bytes before all second ones."""
    if values.dtype.kind != "f":
        values = values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_words(values: np.ndarray) -> bytes:
    """Numbers of 48 bits."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack_words(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


# Seating


class Seats:
    """Customers of many dishes at tables; a dish belongs to one restaurant.

    ``count`` customers of each dish, at least one; ``restaurant`` of each; ``parent``, the parent's probability of each dish;
    ``elsewhere``, tables of each restaurant that stand outside of this process, and ``scale``, by which its own count for more.
    """

    def __init__(self, count, restaurant, parent, restaurants: int, discount: float, rng, elsewhere=None, scale=None) -> None:
        self.restaurant, self.parent, self.discount, self.rng = restaurant, parent, discount, rng
        self.tables = np.ones(len(count), np.int64)
        self.own = np.bincount(restaurant, minlength=restaurants).astype(np.float64)
        self.elsewhere = np.zeros(restaurants) if elsewhere is None else elsewhere
        self.scale = np.ones(restaurants) if scale is None else scale
        self.classes = []
        wide = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
        for k in np.unique(wide[count > 1]):
            rows = np.flatnonzero((wide == k) & (count > 1))
            most = max(1, (1 << 22) >> int(k))
            for at in range(0, len(rows), most):
                part = rows[at:at + most]
                shape = (len(part), 1 << int(k))
                self.classes.append((part, count[part], np.zeros(shape, np.int32), np.zeros(shape, np.int32)))
        for one in self.classes:
            self._arrive(*one)

    def _opening(self, rows, seated):
        """Probability that the next customer of each dish opens a table, when ``seated`` of them sit."""
        place = self.restaurant[rows]
        weight = (CONCENTRATION + self.discount * (self.own[place] * self.scale[place] + self.elsewhere[place])) * self.parent[rows]
        return weight / (weight + seated - self.discount * self.tables[rows])

    def _opened(self, rows, change) -> None:
        self.tables[rows] += change
        np.add.at(self.own, self.restaurant[rows], change)

    def _joined(self, at, sat, sizes, most, skip=None):
        """A table for each of the dishes ``at``: of a random customer, taken in proportion to the table's customers less the discount."""
        out = np.empty(len(at), np.int64)
        left = np.arange(len(at))
        while len(left):
            row, n = at[left], most[left]
            who = (self.rng.random(len(left)) * n).astype(np.int64)
            if skip is not None:
                who += who >= skip[left]
            table = sat[row, who]
            out[left] = table
            # Taken with 1 - discount / customers of the table; else drawn again.
            left = left[self.rng.random(len(left)) * sizes[row, table] < self.discount]
        return out

    def _arrive(self, rows, count, sat, sizes) -> None:
        """Seat all customers one after the other; of many, a sixteenth more at once."""
        sizes[:, 0] = 1
        i = 1
        while i < sat.shape[1]:
            columns = np.arange(i, min(i + max(1, i // 16), sat.shape[1]))
            row, column = np.nonzero(columns[None, :] < count[:, None])
            column = columns[column]
            new = self.rng.random(len(row)) < self._opening(rows, i)[row]
            table = np.where(new, column, 0)
            old = np.flatnonzero(~new)
            table[old] = self._joined(row[old], sat, sizes, np.full(len(old), i))
            sat[row, column] = table
            np.add.at(sizes, (row, table), 1)
            self._opened(rows, np.bincount(row[new], minlength=len(rows)))
            i = int(columns[-1]) + 1

    def sweep(self) -> None:
        """Gibbs moves: ``MOVES`` customers of each dish, or as many as it has, are taken up and seated again."""
        for rows, count, sat, sizes in self.classes:
            every = np.arange(len(rows))
            for _ in range(min(MOVES, sat.shape[1])):
                who = (self.rng.random(len(rows)) * count).astype(np.int64)
                table = sat[every, who]
                sizes[every, table] -= 1
                empty = sizes[every, table] == 0
                self._opened(rows[empty], -1)
                new = self.rng.random(len(rows)) < self._opening(rows, count - 1)
                fresh = np.flatnonzero(new & ~empty)
                table[fresh] = sizes[fresh].argmin(1)
                old = np.flatnonzero(~new)
                table[old] = self._joined(old, sat, sizes, count[old] - 1, who[old])
                sat[every, who] = table
                sizes[every, table] += 1
                self._opened(rows[new], 1)

    def averaged(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each dish, and of each restaurant with those elsewhere, averaged over sweeps after the warm ones."""
        for _ in range(WARM_SWEEPS):
            self.sweep()
        tables, own = np.zeros(len(self.tables)), np.zeros(len(self.own))
        for _ in range(SWEEPS):
            self.sweep()
            tables += self.tables
            own += self.own
        return tables / SWEEPS, own / SWEEPS


def discount_of(counts: np.ndarray | tuple[int, int]) -> float:
    """A discount from how many dishes have one customer and how many two, within 0.1 and 0.9."""
    once, twice = counts if isinstance(counts, tuple) else (int((counts == 1).sum()), int((counts == 2).sum()))
    return float(min(0.9, max(0.1, once / (once + 2 * twice)))) if once + twice else 0.5


# Chunks


class _Chunk:
    """Texts of one chunk as they come in."""

    def __init__(self, kept: list[str]) -> None:
        self.kept, self.rows, self.known, self.codes, self.counts, self.trains, self.tokens = kept, [], [], [], [], [], 0

    def add(self, batch: pa.RecordBatch, text: str, trains: str) -> None:
        found = [words(t, LOWER) for t in texts(batch, text)]
        flat = pa.array([w for x in found for w in x], pa.large_binary()).dictionary_encode()
        self.known.append(np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64))
        self.codes.append(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        self.counts.append(np.array([len(x) for x in found], np.int64))
        self.trains.append(np.array([bool(x) for x in batch.column(trains).to_pylist()], bool))
        self.rows.append(pa.StructArray.from_arrays([batch.column(c) for c in self.kept], self.kept))
        self.tokens += len(flat) + len(found)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        known = np.unique(np.concatenate([*self.known, np.array([BEGIN, END])]))
        code = np.concatenate([np.searchsorted(known, k)[c] for k, c in zip(self.known, self.codes)])
        counts = np.concatenate(self.counts)
        holder = np.repeat(np.arange(len(counts)), counts + 1)
        context, follower = np.zeros(len(holder), np.int64), np.full(len(holder), len(known) - 1)
        begins = np.cumsum(counts + 1) - counts - 1
        inner = np.ones(len(holder), bool)
        inner[begins] = False
        context[inner] = code
        follower[:-1][inner[1:]] = code
        key = context * len(known) + follower
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pair = key[first]
        trained = np.add.reduceat(np.concatenate(self.trains)[holder[order]].astype(np.int64), first)
        per_context = np.bincount(pair // len(known), minlength=len(known))
        each = np.bincount(context, minlength=len(known))
        often = np.flatnonzero(each * 1000 >= len(holder))
        rows = pa.concat_arrays(self.rows)
        values = [
            [number], pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows, schema.field("rows").type), [(counts + 1).tolist()], [len(first)], [known.tobytes()], [pack(per_context)],
            [pack(pair % len(known))], [pack(trained)], [pack(np.diff(np.append(first, len(key))))], [pack(holder[order])],
            [[{"context": int(known[i].astype(np.int64)), "tokens": int(each[i])} for i in often]],
        ]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(values, schema)], schema=schema)


_CHUNK = """n_tokens array<long>, pairs long, words binary, per_context binary, follower binary, trained binary, per_pair binary, holders binary,
    often array<struct<context: long, tokens: long>>"""


def _chunks(docs: DataFrame, kept: list[str], text: str, trains: str) -> DataFrame:
    rows = ArrayType(StructType([StructField(c, docs.schema[c].dataType) for c in kept]))
    schema = StructType([*StructType.fromDDL("chunk long").add("rows", rows), *StructType.fromDDL(_CHUNK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow = _arrow(schema)
        number = TaskContext.get().partitionId() << 24
        chunk = _Chunk(kept)
        for batch in batches:
            chunk.add(batch, text, trains)
            if chunk.tokens >= CHUNK_TOKENS:
                yield chunk.row(number, arrow)
                number, chunk = number + 1, _Chunk(kept)
        if chunk.tokens:
            yield chunk.row(number, arrow)

    return docs.mapInArrow(run, schema)


# Pairs dealt to buckets


_ASKED = "bucket int, chunk long, contexts binary, per_context binary, followers binary, trained binary, per_pair binary, holders binary"


def _asked(chunks: DataFrame, buckets: int, hot: dict[int, int], whole: bool) -> DataFrame:
    """Pairs of each chunk for each bucket; ``whole`` adds the texts that hold them. ``hot`` says over how many buckets a context is dealt."""
    slices = chunks.sparkSession.sparkContext.broadcast(hot)
    schema = StructType.fromDDL(_ASKED)
    names = ["chunk", "words", "per_context", "follower", "trained"] + ["per_pair", "holders"] * whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words = np.sort(np.array([*slices.value, 0], np.int64).view(np.uint64))
        over = np.array([slices.value.get(int(w.astype(np.int64)), 1) for w in hot_words], np.uint64)
        for row in (r for batch in batches for r in batch.to_pylist()):
            known = np.frombuffer(row["words"], np.uint64)
            context = np.repeat(known, unpack(row["per_context"]))
            follower = known[unpack(row["follower"])] >> np.uint64(16)
            bucket = ((context >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            place = np.minimum(np.searchsorted(hot_words, context), len(hot_words) - 1)
            here = np.flatnonzero(hot_words[place] == context)
            bucket[here] = (bucket[here] + follower[here] % over[place[here]]) % np.uint64(buckets)
            order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
            bucket, context, follower, trained = bucket[order].astype(np.int64), context[order], follower[order], unpack(row["trained"])[order]
            if whole:
                each = unpack(row["per_pair"]).astype(np.int64)
                holders = unpack(row["holders"])[_spread((np.cumsum(each) - each)[order], each[order])]
                each = each[order]
                ends = np.append(0, np.cumsum(each))
            cuts = np.flatnonzero(np.append(True, np.append(bucket[1:] != bucket[:-1], True))) if len(bucket) else []
            out = []
            for i, j in zip(cuts, cuts[1:]):
                own = context[i:j]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out.append({
                    "bucket": int(bucket[i]), "chunk": row["chunk"], "contexts": own[first].tobytes(), "per_context": pack(np.diff(np.append(first, len(own)))),
                    "followers": _pack_words(follower[i:j]), "trained": pack(trained[i:j]),
                    "per_pair": pack(each[i:j]) if whole else None, "holders": pack(holders[ends[i]:ends[j]]) if whole else None,
                })
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[at:at + 64], schema=_arrow(schema))

    return chunks.select(*names).mapInArrow(run, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class _Bucket:
    """The pairs of all chunks that one bucket got: each once, with its training count."""

    def __init__(self, table: pa.Table) -> None:
        self.asked = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        own = [np.frombuffer(r["contexts"], np.uint64) for r in self.asked]
        per = [unpack(r["per_context"]).astype(np.int64) for r in self.asked]
        self.contexts = np.unique(np.concatenate(own))
        context = np.concatenate([np.repeat(np.searchsorted(self.contexts, x), n) for x, n in zip(own, per)])
        self.followers, follower = np.unique(np.concatenate([_unpack_words(r["followers"]) for r in self.asked]), return_inverse=True)
        key, self.pair_of = np.unique(context * len(self.followers) + follower, return_inverse=True)
        self.count = np.bincount(self.pair_of, weights=np.concatenate([unpack(r["trained"]) for r in self.asked]), minlength=len(key)).astype(np.int64)
        self.context, self.follower = key // len(self.followers), key % len(self.followers)
        self.customers = np.bincount(self.context, weights=self.count, minlength=len(self.contexts))
        self.seen = np.flatnonzero(self.count)

    def seats(self, parent: np.ndarray, discount: float, seed: int, **more) -> Seats:
        seen = self.seen
        return Seats(self.count[seen], self.context[seen], parent[self.follower[seen]], len(self.contexts), discount, np.random.default_rng(seed), **more)


_SEATED = """bucket int, shard int, followers binary, tables binary, tokens long, vocabulary long, texts long, once long, twice long, all_tables double,
    hot array<struct<context: long, tokens: long, tables: double>>"""


def _first_seating(asked: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """Tables of each word in each bucket, for the shards of the parent; and one row of sums of each bucket, in shard -1."""
    schema = StructType.fromDDL(_SEATED)

    def run(key, table):
        number = key[0].as_py()
        own = _Bucket(table)
        hot_words = np.array(sorted(hot), np.int64).view(np.uint64)
        at = np.flatnonzero(np.isin(own.contexts, hot_words))
        scale = np.ones(len(own.contexts))
        scale[at] = [hot[int(w.astype(np.int64))] for w in own.contexts[at]]
        share = np.bincount(own.follower[own.seen], minlength=len(own.followers))
        discount = discount_of(own.count)
        tables, of_context = own.seats(share / max(1, share.sum()), discount, number, scale=scale).averaged()
        per_word = np.bincount(own.follower[own.seen], weights=tables, minlength=len(own.followers))
        # A table that was there in part of the sweeps sends a customer to the parent by chance.
        per_word = np.floor(per_word + np.random.default_rng(number + 1).random(len(per_word)) * (share > 0)).astype(np.int64)
        shard = (((own.followers >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(buckets + 1))
        out = [{"bucket": number, "shard": s, "followers": _pack_words(own.followers[i:j]), "tables": pack(per_word[i:j])} for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        cold = np.ones(len(own.contexts), bool)
        cold[at] = False
        begin = own.contexts == BEGIN
        out.append({
            "bucket": number, "shard": -1, "tokens": int(own.customers.sum()), "vocabulary": int((cold & (own.customers > 0) & ~begin).sum()),
            "texts": int(own.customers[begin].sum()), "once": int((own.count == 1).sum()), "twice": int((own.count == 2).sum()), "all_tables": float(per_word.sum()),
            "hot": [{"context": int(own.contexts[i].astype(np.int64)), "tokens": int(own.customers[i]), "tables": float(of_context[i])} for i in at],
        })
        return pa.Table.from_pylist(out, schema=_arrow(schema))

    return asked.groupBy("bucket").applyInArrow(run, schema)


def _parent(seated: DataFrame, vocabulary: int, customers: float) -> DataFrame:
    """(bucket, shard, parent): the parent's probability of each word that a bucket named, in its order."""
    schema = StructType.fromDDL("bucket int, shard int, parent binary")

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        asked = [_unpack_words(r["followers"]) for r in rows]
        known, word = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(word, weights=np.concatenate([unpack(r["tables"]) for r in rows]), minlength=len(known)).astype(np.int64)
        seen = np.flatnonzero(count)
        base = 1 / (vocabulary + 1)
        discount = discount_of(count)
        # All shards are parts of one restaurant: each takes the others' words to have as many tables as its own.
        scale = vocabulary / max(1, len(seen))
        seats = Seats(count[seen], np.zeros(len(seen), np.int64), np.full(len(seen), base), 1, discount, np.random.default_rng(key[0].as_py()), scale=np.full(1, scale))
        tables, own = seats.averaged()
        left = np.zeros(len(known))
        left[seen] = count[seen] - discount * tables
        chance = (left + (CONCENTRATION + discount * own[0] * scale) * base) / (CONCENTRATION + customers)
        out, at = [], 0
        for r, x in zip(rows, asked):
            out.append({"bucket": r["bucket"], "shard": r["shard"], "parent": pack(chance[word[at:at + len(x)]].astype(np.float32))})
            at += len(x)
        return pa.Table.from_pylist(out, schema=_arrow(schema))

    return seated.where("shard >= 0").select("bucket", "shard", "followers", "tables").groupBy("shard").applyInArrow(run, schema)


_ANSWER = "chunk long, bucket int, holders binary, score binary, base binary, known binary"


def _second_seating(asked: DataFrame, parent: DataFrame, totals: dict, hot: dict[int, tuple[int, float, int]]) -> DataFrame:
    """What the pairs of each bucket add to the scores of the texts of each chunk. ``hot``: customers, tables and slices of dealt contexts."""
    schema = StructType.fromDDL(_ANSWER)

    def run(left, right):
        if not left.num_rows:
            return _arrow(schema).empty_table()
        own = _Bucket(left)
        number = own.asked[0]["bucket"]
        chance = np.concatenate([unpack(r["parent"]) for r in sorted(right.to_pylist(), key=lambda r: r["shard"])]).astype(np.float64)
        customers, scale, elsewhere = own.customers.copy(), np.ones(len(own.contexts)), np.zeros(len(own.contexts))
        dealt = np.flatnonzero(np.isin(own.contexts, np.array(sorted(hot), np.int64).view(np.uint64)))
        for i in dealt:
            customers[i], elsewhere[i], _ = hot[int(own.contexts[i].astype(np.int64))]
            scale[i] = 0
        discount = totals["discount"]
        tables, of_context = own.seats(chance, discount, number + 7_000_003, elsewhere=elsewhere, scale=scale).averaged()
        of_context = of_context * scale + elsewhere
        left_over = np.zeros(len(own.count))
        left_over[own.seen] = own.count[own.seen] - discount * tables
        weight = (CONCENTRATION + discount * of_context)[own.context] * chance[own.follower]
        score = np.log10((left_over + weight) / (CONCENTRATION + customers[own.context]))
        base = np.log10((customers + 1) / (totals["tokens"] + totals["vocabulary"] + 1))[own.context]
        known = (customers > 0)[own.context]
        out, at = [], 0
        for r in own.asked:
            each, holders = unpack(r["per_pair"]).astype(np.int64), unpack(r["holders"])
            token = np.repeat(own.pair_of[at:at + len(each)], each)
            at += len(each)
            who, holder = np.unique(holders, return_inverse=True)
            sums = [np.bincount(holder, weights=x[token], minlength=len(who)) for x in (score, base)]
            count = np.bincount(holder, weights=known[token], minlength=len(who)).astype(np.int64)
            out.append({"chunk": r["chunk"], "bucket": number, "holders": pack(who), "score": pack(sums[0].astype(np.float32)), "base": pack(sums[1]), "known": pack(count)})
        return pa.Table.from_pylist(out, schema=_arrow(schema))

    return asked.groupBy("bucket").cogroup(parent.groupBy("bucket")).applyInArrow(run, schema)


def _sums(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of each text: the kept columns, n_tokens, n_known, base_score and score."""
    fields = chunks.schema["rows"].dataType.elementType
    schema = StructType([*fields.fields, *StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])

    def run(left, right):
        tokens = np.array(left.column("n_tokens")[0].as_py(), np.int64)
        sums = np.zeros((2, len(tokens)))
        known = np.zeros(len(tokens), np.int64)
        for r in sorted(right.to_pylist(), key=lambda r: r["bucket"]):
            who = unpack(r["holders"])
            sums[0, who] += unpack(r["base"])
            sums[1, who] += unpack(r["score"])
            known[who] += unpack(r["known"]).astype(np.int64)
        rows = left.column("rows").combine_chunks().flatten()
        values = [*[rows.field(i) for i in range(len(fields))], tokens, known, *sums]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], schema=_arrow(schema))

    kept = chunks.select("chunk", "rows", "n_tokens")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def score_texts(docs: DataFrame, trains: str, text: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The log10 probability of every text under the model of the texts for which the boolean column ``trains`` holds.

    Returns ``keep`` (all columns but the text, if not given) and n_tokens (words and one end), n_known (those in training texts),
    train_tokens, base_score (counts plus one, of single words) and score. Words are separated by white space of ASCII, with A-Z
    lower-cased. Null and empty texts have no words, only the end; a null in ``trains`` is false. Texts of any length count whole, equal
    texts get equal scores, and repeated rows count as often as they come. Without training texts all words are equally likely. Kept columns
    named like new ones are left out.

    Contexts are known by 64 bits of hash, following words by 48. Counts, vocabulary and base score are exact.
    Seating is random with fixed seeds. It is synchronous: the moves of a step see each other's tables in the next, and the parent is
    seated between the two seatings of the contexts.
    """
    bound_batches(docs.sparkSession)
    new = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c not in (text, trains)]) if c.lower() not in new]
    chunks = stored(_chunks(docs.select(*dict.fromkeys([*kept, text, trains])), kept, text, trains))
    size = chunks.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    buckets = max(1, -(-size["pairs"] // BUCKET_PAIRS))
    share = max(1, int(HOT_PART * size["tokens"] / buckets))
    # At most one context for each ``share`` tokens.
    often = chunks.select(F.explode("often").alias("x")).groupBy("x.context").agg(F.sum("x.tokens").alias("tokens")).where(F.col("tokens") > share)
    hot = {r["context"]: min(buckets, -(-r["tokens"] // share)) for r in often.collect()} if buckets > 1 else {}
    seated = stored(_first_seating(_asked(chunks, buckets, hot, False), buckets, hot))
    sums = seated.where("shard = -1")
    totals = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "vocabulary", "texts", "once", "twice", "all_tables")]).first().asDict()
    dealt = sums.select(F.explode("hot").alias("x")).groupBy("x.context").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.tables").alias("tables")).collect()
    begin = int(BEGIN.astype(np.int64))
    totals["vocabulary"] += sum(r["tokens"] > 0 and r["context"] != begin for r in dealt) + (totals["tokens"] > 0)
    totals["discount"] = discount_of((totals["once"], totals["twice"]))
    parent = _parent(seated, totals["vocabulary"], totals["all_tables"])
    counts = {r["context"]: (r["tokens"], r["tables"], hot[r["context"]]) for r in dealt}
    answers = _second_seating(_asked(chunks, buckets, hot, True), parent, totals, counts)
    return _sums(chunks, answers).withColumn("train_tokens", F.lit(int(totals["tokens"])).cast("long"))


def op12_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of all whole texts of documents; six of seven are learned from. Null texts count as empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    done = score_texts(docs.withColumn("held_out", held).withColumn("trains", ~held), "trains", keep=["doc_id", "held_out"])
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
