"""SentencePiece encoding and decoding of merge-type (BPE) models, by a table of prefixes.

Each prefix of a text has one last token in the encoding of that prefix. An automaton over the
vocabulary finds the tokens that end at a position; the one that goes with the last token of the prefix
before it (the pair, merged alone, stays this pair) is the last token here. The ids of the whole text are
then read from the table backwards. No merge crosses from a letter to a later blank, so the table is made
for each chunk of blanks and the letters after it, and kept for words that come again.
"""

from __future__ import annotations

import heapq
import os

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import append, held, texts

#: The mark that stands for a blank in pieces.
BLANK = "▁"
#: Largest model file that is sent to the executors.
MODEL_BYTES = 64 << 20
#: Words and token pairs that a worker remembers; a full memory is emptied.
REMEMBERED = 600_000
#: Longer words are not remembered.
WORD_CHARS = 48


class PieceModel:
    """Ids of texts under a merge-type model, as the library's encode gives them without begin and end ids."""

    def __init__(self, proto: bytes) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(sp.get_piece_size())
        self.rank = {sp.id_to_piece(i): sp.get_score(i) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        runs = {p for p in self.rank if len(p) > 1 and not p.strip(BLANK)}
        ranked = [s for p, s in self.rank.items() if len(p) > 1 and p not in runs]
        if any(BLANK in p[1:] for p in self.rank if p not in runs):
            raise ValueError("pieces with a blank after their first character are not supported")
        if len(set(ranked)) < len(ranked) or runs and ranked and max(self.rank[p] for p in runs) >= min(ranked):
            raise ValueError("pieces must have scores of their own, and runs of blanks the lowest")
        self.unknown_id = sp.unk_id()
        self.ids = {p: sp.piece_to_id(p) for p in self.rank}
        self.lengths = {i: len(p) for p, i in self.ids.items()}
        self.names = {i: p for p, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if piece not in runs and self.merged(piece) == [piece]:
                self.ends.add_word(piece, (i, len(piece)))
        self.ends.make_automaton()
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Best pair first, leftmost of equals: the definition, used for token pairs and runs of blanks."""
        parts: list = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (score := self.rank.get(joined := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens' joint text is encoded as these two."""
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        a, b = self.names[first], self.names[second]
        # Two tokens that make a piece never stay apart.
        self.pairs[first << 32 | second] = known = a + b not in self.rank and self.merged(a + b) == [a, b]
        return known

    def table(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        last = [-1] * len(text)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.ends.iter(text):
            if last[end] < 0:
                before = end - length
                if before < 0:
                    last[end] = token
                elif (left := last[before]) >= 0:
                    known = pairs.get(left << 32 | token)
                    if compatible(left, token) if known is None else known:
                        last[end] = token
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.lengths[last[at]]
        return out[::-1]

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown_id]

    def letters(self, text: str) -> list[int]:
        if self.known.issuperset(text):
            return self.table(text)
        out: list[int] = []
        at = 0
        for i, char in enumerate(text):
            if char not in self.known:
                out += (self.table(text[at:i]) if i > at else []) + self.spelled(char)
                at = i + 1
        return out + (self.table(text[at:]) if at < len(text) else [])

    def blanks(self, n: int) -> list[int]:
        return [self.ids[p] for p in self.merged(BLANK * n)] if n else []

    def chunk(self, n: int, body: str) -> bytes:
        """Ids of n blanks and the letters after them. Blanks merge among themselves last, so the letters take theirs first."""
        ids = self.letters(BLANK + body)
        bare = ids[0] == self.ids[BLANK]
        return np.array(self.blanks(n) + ids[1:] if bare else self.blanks(n - 1) + ids, np.int32).tobytes()

    def word(self, body: str) -> bytes:
        """Ids of one blank and the letters after it."""
        if (known := self.words.get(body)) is None:
            known = self.chunk(1, body)
            if len(body) <= WORD_CHARS:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[body] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        found = text.replace(BLANK, " ").split(" ")  # a blank stands before the text, too
        if "" not in found:
            return np.frombuffer(b"".join(map(self.word, found)), np.int32)
        out, n = [], 1
        for body in found:
            if body:
                out.append(self.word(body) if n == 1 else self.chunk(n, body))
                n = 1
            else:
                n += 1
        if n > 1:
            out.append(np.array(self.blanks(n - 1), np.int32).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded``, the text that the ids stand for.

    The model is read on the driver (at most ``MODEL_BYTES``) and sent to the executors. Null and empty texts
    get no ids and an empty ``decoded``. Columns of these names are replaced, others stay; equal rows get
    equal results. Whole texts of any length; no shuffle, one batch of rows in memory at a time.
    """
    if os.path.getsize(model_path) > MODEL_BYTES:
        raise ValueError(f"{model_path} is larger than {MODEL_BYTES} bytes")
    with open(model_path, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        model = held(("pieces", hash(proto.value)), lambda: PieceModel(proto.value))

        def batch(rows):
            found = [model.encode(t or "") for t in texts(rows, text)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            return [ids, [model.decode(x) for x in found]]

        return batch

    return append(docs, "ids array<int>, decoded string", start, needs=[text] if text in ("ids", "decoded") else [], keeps=True)


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
