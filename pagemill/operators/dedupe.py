"""Duplicate removal by text fingerprint: blocks inside a page, records across the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.html import BLOCK_PATTERN, SHORT_FINGERPRINT
from pagemill.functions.text import fingerprint, once


def unique_blocks(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, block_no, block, print``: the first block of each fingerprint in its page; short ones all stay.

    A page is one row, so repeats are found inside the row and nothing is shuffled.
    """

    def kept(prints):
        def row(b, i):
            p = F.get(prints, i)
            keep = (F.length(p) < SHORT_FINGERPRINT) | (F.array_position(prints, p) == i + 1)
            return F.when(keep, F.struct(i.alias("block_no"), b.alias("block"), p.alias("print")))

        return row

    blocks = F.regexp_extract_all(F.col(html), F.lit(BLOCK_PATTERN), F.lit(0))
    rows = once(
        blocks,
        lambda b: once(
            F.transform(b, fingerprint), lambda prints: F.filter(F.transform(b, kept(prints)), lambda r: r.isNotNull())
        ),
    )
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.block_no", "r.block", "r.print")


def unique_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """First record of each fingerprint across the corpus; short texts are exempt.

    Only a 256-bit digest of the fingerprint and the key are shuffled. The aggregate reduces
    a text held by a third of all records before the shuffle, and the join back is on the
    unique key.
    """
    printed = df.select(F.col(key).alias("_k"), fingerprint(F.col(text)).alias("_p"))
    short = F.coalesce(F.length("_p"), F.lit(0)) < SHORT_FINGERPRINT
    digests = printed.select("_k", F.when(short, F.col("_k")).alias("_own"), F.sha2("_p", 256).alias("_d"))
    firsts = digests.groupBy("_own", "_d").agg(F.min("_k").alias("_k")).select("_k")
    return df.join(firsts, df[key] == firsts["_k"], "left_semi")
