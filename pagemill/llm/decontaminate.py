"""Benchmark decontamination: passages of test items in texts.

The items' words, lower-cased and stripped of all else, give windows of consecutive words. One Aho-Corasick
automaton holds all windows and reads each normalised text once; places found are words of the text, and
these are mapped to characters of the original.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import ALNUM, append, checkpoint, texts, words

#: Bytes of item texts in one automaton. More items are read in several blocks, a pass over the texts for each.
BLOCK_BYTES = 16 << 20

_WORD = re.compile(rb"[^ ]+")
FIELDS = "n_words long, hit_words array<struct<first:long,last:long>>, hit_items array<string>, hit_spans array<struct<start:long,end:long>>"


def windows(text: str | None, width: int) -> list[bytes]:
    """Windows of a normalised item, each between blanks; an item of fewer words is one window."""
    found = words(text, ALNUM)
    if not found:
        return []
    return [b" " + b" ".join(found[i : i + width]) + b" " for i in range(max(1, len(found) - width + 1))]


class Scanner:
    """One automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        held = defaultdict(set)
        for item, text in items:
            for window in windows(text, width):
                held[window].add(item)
        self.items = [sorted(x for x in ids if x is not None) for ids in held.values()]
        self.automaton = ahocorasick.Automaton()
        for i, window in enumerate(held):
            # Bytes as characters of the same number: one character of the key is one byte of the text.
            self.automaton.add_word(window.decode("latin-1"), (i, window.count(b" ") - 1))
        self.automaton.make_automaton()

    def scan(self, text: str | None, known: list[tuple[int, int]]) -> tuple[int, list, set, list]:
        """Number of words, merged (first, last) words that are hit, items found, and the hits' characters."""
        raw = text.encode() if text else b""
        found = raw.translate(ALNUM).split()
        items: set = set()
        hits = list(known)
        if found and len(self.automaton):
            joined = b" " + b" ".join(found) + b" "
            at, word = 0, -1
            for end, (i, n) in self.automaton.iter(joined.decode("latin-1")):
                word += joined.count(b" ", at, end + 1)  # the blank at ``end`` follows this word
                at = end + 1
                hits.append((word - n, word - 1))
                items.update(self.items[i])
        merged: list[list[int]] = []
        for first, last in sorted(hits):
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        return len(found), merged, items, _characters(raw, merged) if merged else []


def _characters(raw: bytes, merged: list[list[int]]) -> list[tuple[int, int]]:
    """Characters of the original from the first to the last word of each run."""
    places = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
    out, at, chars = [], 0, 0
    for first, last in merged:
        start, end = places[first][0], places[last][1]
        begin = chars + len(raw[at:start].decode())
        chars, at = begin + len(raw[start:end].decode()), end
        out.append((begin, chars))
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, width: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, hit_words (first and last word of each run), hit_items (sorted as text) and hit_spans (characters).

    Items are sent to the executors in blocks of at most ``BLOCK_BYTES`` of text; a larger benchmark takes one
    pass per block, which adds its hits to those of the passes before, so no item is left out. A null or empty
    text has no words; an item without words hits nothing; an item with a null key hits words but is not named.
    Repeated items count once. Columns with the new names are replaced. No shuffle.
    """
    sized = items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t")).where("t is not null").distinct()
    sized = checkpoint(sized.withColumn("size", F.octet_length("t") + 64).withColumn("spread", F.xxhash64("k", "t")))
    total = sized.agg(F.sum("size"), F.max("size")).first()
    blocks = 1 if not total[0] else -(-2 * total[0] // BLOCK_BYTES) if total[0] > BLOCK_BYTES else 1
    out = docs
    for block in range(blocks):
        rows = sized.where(F.pmod("spread", F.lit(blocks)) == block).select("k", "t").collect()
        if block:
            out = checkpoint(out)
        out = _pass(out, [tuple(r) for r in rows], width, text, block > 0)
    return out


def _pass(docs: DataFrame, items: list[tuple], width: int, text: str, further: bool) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def start():
        scanner = Scanner(sent.value, width)

        def batch(rows):
            old = list(zip(rows.column("hit_words").to_pylist(), rows.column("hit_items").to_pylist())) if further else [((), ())] * len(rows)
            found = [scanner.scan(t, [(h["first"], h["last"]) for h in hits]) for t, (hits, _) in zip(texts(rows, text), old)]
            return [
                [f[0] for f in found],
                [[{"first": a, "last": b} for a, b in f[1]] for f in found],
                [sorted({*f[2], *names}) for f, (_, names) in zip(found, old)],
                [[{"start": a, "end": b} for a, b in f[3]] for f in found],
            ]

        return batch

    return append(docs, FIELDS, start, needs=["hit_words", "hit_items", "n_words", "hit_spans"] if further else [])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
with items as (select item_id, {_WORDS} as w from benchmark),
item_windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as win
  from (select item_id, w, unnest(range(greatest(1, len(w) - 9))) as i from items where len(w) > 0)
),
docs as (select doc_id, {_WORDS} as w from documents),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as win
  from (select doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) as i from docs, (select distinct n from item_windows))
),
hits as (select d.doc_id, d.n, d.i, t.item_id from doc_windows d join item_windows t on d.win = t.win and d.n = t.n),
hit_words as (select doc_id, count(distinct i + k) as n_hit from (select doc_id, i, unnest(range(n)) as k from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit_words h on d.doc_id = h.doc_id left join hit_items i on d.doc_id = i.doc_id
"""
