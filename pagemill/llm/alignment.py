"""Alignment of two tokenizers over the same texts: which token of the one covers bytes of which token of the other.

Every text is tokenised whole by a byte-level BPE (A) and a SentencePiece model (B). Where a token of both ends and a token
of both that is marked by a blank begins, the text is cut: these anchors are verified from the bytes of the tokens, not
taken from the text. Between anchors stand short windows of token ids, and the alignment of a window follows from
its ids alone, so it is remembered by the pair of id tuples. Within a window the ends that both share make groups, and each
stretch between two ends of either makes a link of the tokens over it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import append, held, stored, texts

#: Words, and windows, that a worker remembers: beyond these, words not met since the last time are forgotten, and all windows.
REMEMBERED = 120_000
#: Characters of texts that are worked on together.
PART_CHARS = 1_500_000
#: Longer words are remembered for one batch only.
WORD_CHARS = 64
#: Words that a library encodes in one call.
CALL_WORDS = 4000
#: Largest tokenizer file that is sent to the executors.
MODEL_BYTES = 64 << 20
#: Id pairs of one broadcast; more pairs are more passes over the stored alignment.
BLOCK_PAIRS = 1_000_000

#: Words of ASCII and Latin letters.
_COMMON = re.compile(r"[\x21-\x7e\n\r\t À-ÖØ-öø-ɏ]*").fullmatch
_INNER = re.compile(r" (?=\s)")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


class Vocabulary:
    """Bytes of each id, their number, whether they begin with a blank, and the ids as text before a comma, bar or semicolon."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.before_comma, self.before_bar, self.before_end = (np.array([f"{i}{sign}" for i in range(len(tokens))], object) for sign in ",|;")
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.marked = np.array([t[:1] == b" " for t in tokens], bool)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def byte_level_tokens(tokenizer) -> list[bytes]:
    letters = _byte_letters()
    found = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in found]


def ranked_encoding(a_json: str, tokens: list[bytes]):
    """A faster library for the same ids, if the file is a plain byte-level BPE whose ids follow its merges; else None.

    Both cut a text by classes of characters, whose tables may differ in rare scripts, so it is asked for the words of ``_COMMON`` only.
    """
    import tiktoken

    kind = json.loads(a_json)
    model, before = kind["model"], kind.get("pre_tokenizer") or {}
    plain = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    known, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if not plain or model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")):
        return None
    if sorted(known.values())[:256 + len(merges)] != list(range(256 + len(merges))) or any(known.get(x + y) != 256 + i for i, (x, y) in enumerate(merges)):
        return None
    # Fixed value: how byte-level BPE cuts a text.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks={tokens[i]: i for i in range(256 + len(merges))}, special_tokens={})


def piece_tokens(library) -> list[bytes]:
    every = range(library.get_piece_size())
    return [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in every]


def split_words(text: str) -> list[str]:
    """The text in parts that either tokenizer encodes by itself, the blank before each left out.

    A part begins at a blank between two characters that are no white space, so that no pre-token of A and no run of blanks of B goes over it.
    """
    found = text.split(" ")
    if text[0] != " " and text[-1] != " " and not _INNER.search(text):
        return found
    out = [found[0]]
    bare = found[0] == ""
    for word in found[1:]:
        if bare or word == "" or word[0].isspace():
            out[-1] += " " + word
        else:
            out.append(word)
        bare = word == ""
    return out


class Aligner:
    """Both tokenizers, and what a worker remembers of words and windows."""

    def __init__(self, a_json: str, b_proto: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a_library = Tokenizer.from_str(a_json)
        self.a_library.encode_special_tokens = True
        self.b_library = sentencepiece.SentencePieceProcessor(model_proto=b_proto)
        every = piece_tokens(self.b_library)
        if any(b" " in t.lstrip(b" ") for t in every):
            raise ValueError("pieces with a blank after other characters are not supported")
        self.a, self.b = Vocabulary(byte_level_tokens(self.a_library)), Vocabulary(every)
        self.a_ranks = ranked_encoding(a_json, self.a.tokens)
        self.a_words: dict[str, bytes] = {}
        self.b_words: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.faulty: set[str] = set()
        self.windows: dict[tuple[bytes, bytes], int] = {}
        self.text_of: list[str] = []
        self.pairs_of: list[bytes] = []
        self.groups_of: list[int] = []

    def learn_words(self, found: list[str]) -> None:
        """Ids of words, many in one call where the blank between them keeps them apart."""
        for at in range(0, len(found), CALL_WORDS):
            part = found[at:at + CALL_WORDS]
            plain = [w for w in part if w and not w[0].isspace() and w[-1] != " " and _COMMON(w)]
            whole = [b" " + w.encode() for w in plain]
            text = " ".join(plain)
            encode = self.a_ranks.encode_ordinary if self.a_ranks else lambda t: self.a_library.encode(t, add_special_tokens=False).ids
            a = self.cut(self.a, encode(" " + text), whole) if plain else []
            b = self.cut(self.b, self.b_library.encode(text), whole) if plain else []
            if a is None or b is None:
                plain, a, b = [], [], []
            self.a_words.update(zip(plain, a))
            self.b_words.update(zip(plain, b))
            for word in part if not plain else set(part).difference(plain):
                one, other = self.a_library.encode(" " + word, add_special_tokens=False).ids, self.b_library.encode(word)
                self.a_words[word], self.b_words[word] = _bytes(one), _bytes(other)
                bare = b" " + word.encode()
                if b"".join([self.a.tokens[i] for i in one]) != bare or b"".join([self.b.tokens[i] for i in other]) != bare:
                    self.faulty.add(word)

    @staticmethod
    def cut(vocabulary: Vocabulary, ids: list[int], words: list[bytes]) -> list[bytes] | None:
        """The ids of each word out of those of all; None if the tokens don't spell the words or go over their ends."""
        if b"".join([vocabulary.tokens[i] for i in ids]) != b"".join(words):
            return None
        flat = np.array(ids, np.int32)
        ends, word_ends = np.cumsum(vocabulary.lengths[flat]), np.cumsum([len(w) for w in words])
        last = np.searchsorted(ends, word_ends)
        if (ends[last] != word_ends).any():
            return None
        data, stops = flat.tobytes(), (4 * last + 4).tolist()
        return [data[i:j] for i, j in zip([0, *stops], stops)]

    def tokenise(self, rows: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B, the ids of all texts in a row, and how many each has; none where the tokens' bytes are not those of blank and text."""
        found = [split_words(text) if text else [] for text in rows]
        flat = pa.array([w for x in found for w in x], pa.large_string()).dictionary_encode()
        every, word = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.a_words) > REMEMBERED:  # words of the last time stay a while
            self.old, self.a_words, self.b_words = (self.a_words, self.b_words), {}, {}
            self.faulty &= self.old[0].keys()
        new = [w for w in every if w not in self.a_words]
        for ids, memory in zip(self.old, (self.a_words, self.b_words)):
            memory.update((w, ids[w]) for w in new if w in ids)
        new = [w for w in new if w not in self.a_words]
        self.learn_words(new)
        held = np.append(0, np.cumsum([len(x) for x in found]))
        out = []
        for memory in (self.a_words, self.b_words):
            parts = [memory[w] for w in every]
            sizes = np.array([len(x) // 4 for x in parts], np.int64)
            ids = np.frombuffer(b"".join(parts), np.int32)[_spread((np.cumsum(sizes) - sizes)[word], sizes[word])]
            out.append((ids, np.diff(np.append(0, np.cumsum(sizes[word]))[held])))
        if self.faulty and not self.faulty.isdisjoint(every):
            out = self.spelled(rows, found, out)
        for w in new:
            if len(w) > WORD_CHARS:
                del self.a_words[w], self.b_words[w]
                self.faulty.discard(w)
        return out

    def spelled(self, rows: list, found: list[list[str]], out: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """``tokenise`` without the ids of texts with faulty words, unless their tokens spell them as a whole."""
        (a, n_a), (b, n_b) = out
        keep = np.ones(len(rows), bool)
        for i in (i for i, x in enumerate(found) if not self.faulty.isdisjoint(x)):
            own_a, own_b = a[n_a[:i].sum():n_a[:i + 1].sum()], b[n_b[:i].sum():n_b[:i + 1].sum()]
            whole = b" " + rows[i].encode()
            keep[i] = self.a.joined(own_a) == whole == self.b.joined(own_b)
        return [(ids[np.repeat(keep, n)], n * keep) for ids, n in out]

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])

    def anchors(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of A and of B with which windows end; ``a_last`` and ``b_last`` are those that end a text."""
        ends_a, ends_b = self.ends(a, b)
        stops_a, stops_b = np.append(self.a.marked[a][1:], True), np.append(self.b.marked[b][1:], True)
        stops_a[a_last] = True
        stops_b[b_last] = True
        at_a, at_b = np.flatnonzero(stops_a), np.flatnonzero(stops_b)
        place = np.searchsorted(ends_b[at_b], ends_a[at_a])
        shared = ends_b[at_b][np.minimum(place, len(at_b) - 1)] == ends_a[at_a]
        return at_a[shared], at_b[place[shared]]

    def align_windows(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Groups and links of new windows, all at once, remembered by their ids."""
        a = np.frombuffer(b"".join(k[0] for k in keys), np.int32)
        b = np.frombuffer(b"".join(k[1] for k in keys), np.int32)
        ends_a, ends_b = self.ends(a, b)
        place = np.searchsorted(ends_b, ends_a)
        shared = ends_a[ends_b[place] == ends_a]
        every = np.sort(np.concatenate([ends_a[ends_b[place] != ends_a], ends_b]), kind="stable")
        pairs = a[np.searchsorted(ends_a, every)].astype(np.int64) * len(self.b.tokens) + b[np.searchsorted(ends_b, every)]
        # Tokens in the order in which they are told: group by group, A before B.
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        names = np.concatenate([np.where(last_a, self.a.before_bar[a], self.a.before_comma[a]), np.where(last_b, self.b.before_end[b], self.b.before_comma[b])])
        names = names[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        sizes = np.cumsum([len(k[0]) + len(k[1]) for k in keys]) // 4
        limits = ends_a[np.cumsum([len(k[0]) for k in keys]) // 4 - 1]
        link_ends, group_ends = np.searchsorted(every, limits, "right"), np.searchsorted(shared, limits, "right")
        data, link_ends = pairs.tobytes(), (8 * link_ends).tolist()
        known = len(self.text_of)
        self.text_of += ["".join(names[i:j])[:-1] for i, j in zip([0, *sizes.tolist()], sizes.tolist())]
        self.pairs_of += [data[i:j] for i, j in zip([0, *link_ends], link_ends)]
        self.groups_of += np.diff(np.append(0, group_ends)).tolist()
        self.windows.update(zip(keys, range(known, len(self.text_of))))

    def distinct(self, a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first window of each tuple of ids, and which of these each window equals."""
        key = np.zeros(len(stop_a), np.uint64)
        spans = []
        for ids, stop, factor in ((a, stop_a, 0x9E3779B97F4A7C15), (b, stop_b, 0xC2B2AE3D27D4EB4F)):
            begin = np.append(0, stop[:-1] + 1)
            length = stop + 1 - begin
            within = np.arange(len(ids)) - np.repeat(begin, length)
            powers = np.cumprod(np.full(int(length.max()) + 1, factor, np.uint64))
            mixed = (ids.astype(np.uint64) + np.uint64(0x165667B19E3779F9)) * powers[within]
            mixed ^= mixed >> np.uint64(31)
            key = (key ^ np.add.reduceat(mixed, begin)) * np.uint64(0xD6E8FEB86659FD93)
            spans.append((ids, begin, length))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        for ids, begin, length in spans:  # equal keys must be equal ids
            alike = first[which]
            if (length[alike] != length).any() or (ids[_spread(begin[alike], length)] != ids).any():
                return np.arange(len(key)), np.arange(len(key))
        return first, which

    def columns(self, rows: list[str | None]) -> list:
        """Columns of ``align`` for the texts of a batch, made from some of them at a time."""
        ends = np.cumsum([len(t or "") for t in rows]) // PART_CHARS
        cuts = np.flatnonzero(np.append(True, np.append(ends[1:] != ends[:-1], True))) if rows else [0, 0]
        parts = [[x if isinstance(x, pa.Array) else pa.array(x) for x in self.batch(rows[i:j])] for i, j in zip(cuts, cuts[1:])]
        return [pa.concat_arrays(x) for x in zip(*parts)]

    def batch(self, rows: list[str | None]) -> list:
        """Columns of ``align`` for some texts."""
        if len(self.windows) > REMEMBERED:
            for memory in (self.windows, self.text_of, self.pairs_of, self.groups_of):
                memory.clear()
        (a, n_a), (b, n_b) = self.tokenise(rows)
        a_bytes, b_bytes = a.tobytes(), b.tobytes()
        if not len(a):
            empty = pa.array([[]] * len(rows), pa.list_(pa.int64()))
            return [n_a, n_b, n_a, n_a, [""] * len(rows), empty, pa.array([[]] * len(rows), pa.list_(pa.int32()))]
        stop_a, stop_b = self.anchors(a, b, np.cumsum(n_a)[n_a > 0] - 1, np.cumsum(n_b)[n_b > 0] - 1)
        first, which = self.distinct(a, b, stop_a, stop_b)
        cut_a, cut_b = np.append(0, 4 * stop_a + 4), np.append(0, 4 * stop_b + 4)
        places = (cut_a[first].tolist(), cut_a[first + 1].tolist(), cut_b[first].tolist(), cut_b[first + 1].tolist())
        keys = [(a_bytes[i:j], b_bytes[k:m]) for i, j, k, m in zip(*places)]
        new = [k for k in keys if k not in self.windows]
        if new:
            self.align_windows(list(dict.fromkeys(new)))
        numbers = list(map(self.windows.__getitem__, keys))
        told = np.array([self.text_of[i] for i in numbers], object)[which].tolist()
        parts = [self.pairs_of[i] for i in numbers]
        links = np.array([len(x) // 8 for x in parts], np.int64)
        pairs = np.frombuffer(b"".join(parts), np.int64)[_spread((np.cumsum(links) - links)[which], links[which])]
        # How many windows, groups and links stand before each text's end.
        window_ends = np.append(0, np.searchsorted(stop_a, np.cumsum(n_a)))
        groups = np.append(0, np.cumsum(np.array([self.groups_of[i] for i in numbers], np.int64)[which]))
        n_links = np.diff(np.append(0, np.cumsum(links[which]))[window_ends])
        wide = len(self.a.tokens) * len(self.b.tokens)
        ordered = np.sort(np.repeat(np.arange(len(rows)), n_links) * wide + pairs)
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        each = np.diff(np.append(head, len(ordered)))
        offsets = pa.array(np.searchsorted(ordered[head] // wide, np.arange(len(rows) + 1)), pa.int32())
        bounds = window_ends.tolist()
        return [
            n_a, n_b, np.diff(groups[window_ends]), n_links, [";".join(told[i:j]) for i, j in zip(bounds, bounds[1:])],
            pa.ListArray.from_arrays(offsets, pa.array(ordered[head] % wide)), pa.ListArray.from_arrays(offsets, pa.array(each, pa.int32())),
        ]


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` with the alignment of two tokenizers over blank and text; ``a_path`` is a byte-level BPE, ``b_path`` a SentencePiece model.

    New columns: ``n_a`` and ``n_b`` tokens; ``n_groups`` between ends that both share; ``n_links``, pairs of token occurrences that
    share bytes; ``groups``, ids as ``a1,a2|b1;a3|b2,b3``; ``pairs``, the distinct linked id pairs as ``a * size of B + b``
    in order; ``pair_links``, how many links each has. Strings of special tokens are plain text. Null and empty texts, and
    texts that the tokens of A or B do not spell byte by byte, have no tokens: zeros, an empty text and empty arrays. Whole texts of any length;
    equal rows get equal results; columns of these names are replaced. Both files are read on the driver and are at most
    ``MODEL_BYTES``. No shuffle; a worker holds one Arrow batch and ``REMEMBERED`` words and windows.
    """
    for path in (a_path, b_path):
        if os.path.getsize(path) > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        files = docs.sparkSession.sparkContext.broadcast((a_file.read(), b_file.read()))

    def start():
        aligner = held(("align", hash(files.value)), lambda: Aligner(*files.value))
        return lambda rows: aligner.columns(texts(rows, text))

    ddl = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<int>"
    names = [part.split()[0] for part in ddl.split(", ")]
    return append(docs, ddl, start, needs=[text] if text in names else [], keeps=True)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, documents, best): in how many rows of ``align`` a pair is linked, and whether no pair of its A id is in more.

    Rows without links count for nothing. Counts combine before the shuffle.
    """
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = stored(counts.withColumn("a", F.floor(F.col("pair") / b_size)))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).cast("long").alias("best"))


def sum_links(aligned: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, n_best, count_sum) of each row of ``align`` with links: how many of them are ``best``, and the sum of their documents.

    The pairs are sent to the rows in broadcast blocks of about ``BLOCK_PAIRS``, by hash; each block is a pass over
    ``aligned``, which should be a stored table. ``key`` tells the rows apart.
    """
    blocks = max(1, -(-counts.count() // BLOCK_PAIRS))
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))
    linked = aligned.select(key, F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("links"))
    parts = None
    for i in range(blocks):
        part = linked.where(block == i).join(F.broadcast(counts.where(block == i)), "pair")
        part = part.groupBy(key).agg(F.sum(F.col("links") * F.col("best")).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")) if blocks > 1 else parts


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment of every whole text of documents, and how usual its links are in the corpus. Null and empty texts: zeros and ''."""
    import public_tokenizers
    import sentencepiece

    b_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = align(docs, public_tokenizers.path("byte_bpe_50k.json"), b_path)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    done = stored(done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "pair_links").withColumn("row", F.monotonically_increasing_id()))
    counts = stored(pair_counts(done, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()))
    sums = sum_links(done, counts, "row")
    out = done.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
