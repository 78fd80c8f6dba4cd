"""Shards of near equal bytes by histogram sort.

Rows have a 64-bit key; equal texts have neighbouring keys. Candidate boundaries (probes) are refined in rounds:
each round counts the exact bytes and rows below every probe in one aggregation, and keeps for each boundary the
two probes between which it lies, until it is within tolerance. Then rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import bound_batches, checkpoint

#: Probes counted in one round; the rows that a round brings to the driver are at most as many.
PROBES = 4096
#: Bits of a key that part rows of equal texts.
TIE_BITS = 24
#: Share of a shard's bytes that a boundary may be off, where single rows allow it.
TOLERANCE = 0.001
#: Rows that a task numbers, about.
SLICE_ROWS = 500_000

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def sort_key(text: Column, tie: Column) -> Column:
    """Neighbouring keys for equal texts, spread by the hash of ``tie`` so that a large group can be cut."""
    mask = (1 << TIE_BITS) - 1
    group = F.xxhash64(F.coalesce(text, F.lit("")))
    return group.bitwiseAND(F.lit(~mask)).bitwiseOR(F.xxhash64(tie).bitwiseAND(F.lit(mask)))


def _below(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) with a key below each of the sorted probes."""
    edges = np.array(probes, np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    counted = keyed.groupBy(bucket("key").alias("bucket")).agg(F.sum("size").alias("b"), F.count("*").alias("r")).collect()
    sizes, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in counted:
        sizes[r["bucket"]], rows[r["bucket"]] = int(r["b"]), r["r"]
    out, b, n = [], 0, 0
    for i in range(len(probes)):
        b, n = b + sizes[i], n + rows[i]
        out.append((b, n))
    return out


def splitters(keyed: DataFrame, targets: list[float], slack: list[float], total: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) for each of the rising targets of bytes below; ``slack`` is each one's tolerance.

    A boundary is settled when it is within its slack, or when no row or no key lies between its two probes.
    """
    low = [(LOWEST, 0, 0)] * len(targets)
    high = [(HIGHEST, *total)] * len(targets)  # the highest key itself belongs to the last slice

    def settled(i: int) -> bool:
        (k1, b1, r1), (k2, b2, r2) = low[i], high[i]
        return min(targets[i] - b1, b2 - targets[i]) <= slack[i] or k2 - k1 <= 1 or r2 - r1 <= 1

    while open_ := [i for i in range(len(targets)) if not settled(i)]:
        each = max(3, PROBES // len(open_))
        gaps = {(low[i][0], high[i][0]) for i in open_}
        probes = sorted({k1 + (k2 - k1) * j // (each + 1) for k1, k2 in gaps for j in range(1, each + 1)} - {LOWEST})
        counts = [(p, b, r) for p, (b, r) in zip(probes, _below(keyed, probes))]
        bytes_below = [c[1] for c in counts]
        for i in open_:
            at = bisect_right(bytes_below, targets[i])
            if at > 0:
                low[i] = max(low[i], counts[at - 1])
            if at < len(counts):
                high[i] = min(high[i], counts[at])
    return [min((low[i], high[i]), key=lambda c: (abs(c[1] - targets[i]), c[0])) for i in range(len(targets))]


def shard_rows(docs: DataFrame, shards: int = 16, text: str = "text", tie: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) of every row with size, shard and slot.

    Size is the text's UTF-8 bytes plus 1, null as empty. Shards 0 to ``shards`` - 1 are ranges of keys whose
    bytes are equal within ``TOLERANCE`` or one row; slots number a shard's rows from 0 without gaps, by key and
    then by tie. Equal texts stand together and are cut only where a boundary meets them; rows that are equal in text
    and tie stay together. Columns named size, shard or slot are replaced. An empty table gives no rows.

    Shards are cut into slices of about ``SLICE_ROWS`` rows by the same counting, so that no task numbers a whole
    shard. Rounds read a narrow checkpoint of keys and sizes; the rows themselves move once, to their slices.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in (carry or docs.columns) if c.lower() not in ("size", "shard", "slot")]
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("size"), sort_key(F.col(text), F.col(tie)).alias("__key"), F.xxhash64(tie).alias("__tie"))
    narrow = checkpoint(keyed.select(F.col("__key").alias("key"), "size"))
    total = narrow.agg(F.sum("size"), F.count("*")).first()
    total = (int(total[0] or 0), total[1])
    slices = max(1, -(-total[1] // (SLICE_ROWS * shards)))
    # A table of few rows still goes to as many tasks as the session gives a shuffle.
    slices = max(slices, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    targets = [total[0] * i / (shards * slices) for i in range(1, shards * slices)]
    whole = total[0] / shards
    slack = [whole * TOLERANCE if i % slices == 0 else whole / slices / 4 for i in range(1, shards * slices)]
    found = splitters(narrow, targets, slack, total)
    keys, rows_below = [c[0] for c in found], [0, *[c[2] for c in found]]
    # Equal boundaries leave empty slices; a row's slice is the last that begins at or below its key.
    edges = np.array(keys, np.int64)
    first = np.array(rows_below, np.int64)
    begins = np.array([rows_below[s - s % slices] for s in range(shards * slices)], np.int64)

    @F.pandas_udf("slice int, shard int, base long")
    def place(key: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(edges, key.to_numpy(), side="right")
        return pd.DataFrame({"slice": at.astype(np.int32), "shard": (at // slices).astype(np.int32), "base": first[at] - begins[at]})

    placed = keyed.withColumn("__at", place("__key"))
    number = F.row_number().over(Window.partitionBy(F.col("__at.slice")).orderBy("__key", "__tie"))
    return placed.withColumn("__number", number).select(
        *[F.col(f"`{c}`") for c in kept], "size", F.col("__at.shard").alias("shard"), (F.col("__at.base") + F.col("__number") - 1).alias("slot"))


def op3_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    done = shard_rows(docs, carry=["doc_id", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
