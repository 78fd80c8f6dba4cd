"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link in (a, b): the smallest node of its component.

    Large and small star steps by turns: each node's neighbours move to its smallest one, until no row changes.
    Minima are aggregates that combine before the shuffle; the join back to a hub's many neighbours is an inner
    join that adaptive execution may split. Links to oneself and repeated links count once; no links, no rows.
    """
    edges = settled(_ordered(links.select("a", "b")))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        large = _to_smallest(both, F.col("b") > F.col("a"))
        small = _to_smallest(_ordered(large).select("a", "b"), None)
        edges = settled(_ordered(small))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    # Every edge now leads from a node to its smallest one.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links from the larger node a to the smaller b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_smallest(links: DataFrame, which) -> DataFrame:
    """Links (a, b) with b moved under the smallest of a and its neighbours; ``which`` says which b move."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = links.join(least, "a")
    moved = joined if which is None else joined.where(which)
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out if which is not None else out.union(least.select("a", F.col("m").alias("b")))
