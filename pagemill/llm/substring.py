"""Substring dedup by content-defined chunks.

A gear rolling hash over the last bytes marks boundaries that depend on these bytes alone, so an insertion moves
the boundaries after it and changes none. Chunks begin at such a boundary and end at the first one that
lies far enough behind; equal passages have equal chunks wherever they stand. Chunks are found again by digest, and
chunks that follow or overlap each other are joined to passages.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import append, checkpoint, texts

#: Bytes that the rolling hash looks back on.
WINDOW = 16
#: A chunk may begin at one of so many bytes, and end at one of so many, on average.
BEGIN_EVERY, END_EVERY = 32, 8
#: Least bytes of a chunk.
LEAST_BYTES = 128

_rng = random.Random(20)
#: A number for each byte, from a fixed seed.
GEAR = np.array([_rng.getrandbits(32) for _ in range(256)], np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear numbers of the last ``WINDOW`` bytes, each shifted once more per byte."""
    out = GEAR[raw]
    span = 1
    while span < WINDOW:  # sums of 1, 2, 4 ... bytes from halves
        out[span:] += out[:-span].copy() << np.uint32(span)
        span *= 2
    return out


def chunks(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, first characters and ends (exclusive) of a text's chunks, by place; empty for texts shorter than a chunk."""
    data = text.encode() if text else b""
    none = np.empty(0, np.int64)
    if len(data) < LEAST_BYTES:
        return none, none, none
    raw = np.frombuffer(data, np.uint8)
    hashed = gear_hashes(raw) >> np.uint32(WINDOW - 6)  # the low bits have seen few bytes
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = (raw & 0xC0) == 0x80  # places inside a character
    ends = np.flatnonzero((hashed % END_EVERY == 0) & ~inside[1:]) + 1
    begins = np.flatnonzero((hashed % BEGIN_EVERY == 0) & ~inside[1:]) + 1
    begins, ends = np.concatenate(([0], begins)), np.concatenate((ends, [len(raw)]))
    at = np.searchsorted(ends, begins + LEAST_BYTES)
    begins, at = begins[at < len(ends)], at[at < len(ends)]
    ends = ends[at]
    digests = np.fromiter((xxhash.xxh64_intdigest(data[b:e]) for b, e in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
    chars = np.concatenate(([0], np.cumsum(~inside[:-1])))
    return digests.view(np.int64), chars[begins], chars[ends]


def chunk_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(digest, key, row, start, end) of every chunk; ``row`` tells rows of equal keys apart."""
    numbered = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).withColumn("row", F.monotonically_increasing_id())

    def start():
        def batch(rows):
            found = [chunks(t) for t in texts(rows, "body")]
            offsets = pa.array(np.cumsum([0, *(len(f[0]) for f in found)], dtype=np.int32), pa.int32())
            flat = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
            parts = [pa.array(c, pa.int64()) for c in flat]
            return [pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["digest", "start", "end"]))]

        return batch

    listed = append(numbered, "chunks array<struct<digest:long,start:long,end:long>>", start).drop("body")
    return listed.select("key", "row", F.inline("chunks"))


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, first_key, first) of every passage that stands in more than one row of ``docs``.

    Passages are unions of overlapping or adjoining repeated chunks, in characters, end exclusive; first_key is the
    smallest key among the rows that hold the passage's first chunk, and first says that this row is the
    first holder of all its chunks (of equal keys each is). Repeats within one row alone do not count. A common passage
    of twice ``LEAST_BYTES`` is found with a chance of some 98 %, one of 340 bytes of over 99 %; one shorter than
    ``LEAST_BYTES`` never. Null, empty and short texts have no chunks but for the last one that reaches their end.
    Chunks are equal if their 64-bit digests and lengths are. Rows of one chunk meet in a join that adaptive
    execution may split; smallest keys are aggregates that combine before the shuffle; a task gathers one text's chunks.
    """
    rows = chunk_rows(docs, text, key).withColumn("size", F.col("end") - F.col("start"))
    other = rows.select(F.col("digest").alias("o_digest"), F.col("size").alias("o_size"), F.col("row").alias("o_row"))
    same = (F.col("digest") == F.col("o_digest")) & (F.col("size") == F.col("o_size")) & (F.col("row") != F.col("o_row"))
    shared = checkpoint(rows.join(other, same, "left_semi"))
    first = shared.groupBy("digest", "size").agg(F.min("key").alias("first_key"))
    held = shared.join(first, ["digest", "size"]).groupBy("row").agg(
        F.first("key").alias("key"), F.sort_array(F.collect_list(F.struct("start", "end", "first_key"))).alias("chunks"))

    def start():
        def batch(rows):
            out = []
            for own, found in zip(rows.column("key").to_pylist(), rows.column("chunks").to_pylist()):
                joined: list[dict] = []
                for c in found:
                    mine = c["first_key"] is None or c["first_key"] == own
                    if joined and c["start"] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], c["end"])
                        joined[-1]["first"] &= mine
                    else:
                        joined.append({"start": c["start"], "end": c["end"], "first_key": c["first_key"], "first": mine})
                out.append(joined)
            return [out]

        return batch

    kind = dict(docs.dtypes)[key]
    passages = append(held, f"passages array<struct<start:long,end:long,first_key:{kind},first:boolean>>", start)
    return passages.select(F.col("key").alias(key), F.inline("passages"))


def op2_substring(spark, sf_dir: str) -> DataFrame:
    """Every passage that documents share, with the document that has it first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).withColumnRenamed("first_key", "first_doc_id")
