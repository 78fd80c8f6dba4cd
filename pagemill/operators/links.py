"""Links, redirects and media references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import strip_tags, strip_ws
from pagemill.functions.urls import normalized_link
from pagemill.session import checkpoint

HREF = r"""(?is)<a\b[^>]*\bhref=["']([^"']*)["'][^>]*>(.*?)</a>"""


def page_links(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per anchor: ``key, link_no, href, text``."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))
    texts = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(2))
    pairs = F.zip_with(hrefs, texts, lambda h, t: F.struct(h.alias("href"), strip_ws(strip_tags(t)).alias("text")))
    return df.select(key, F.posexplode(pairs).alias("link_no", "l")).select(key, "link_no", "l.href", "l.text")


def is_internal(href: Column, origin: str) -> Column:
    special = href.rlike("^(?:#|mailto:|tel:|javascript:)") | (href == "")
    absolute = href.rlike("(?i)^(?:[a-z][a-z0-9+.-]*:)?//")
    same = F.startswith(F.lower(href), F.lit(origin.lower() + "/")) | (F.lower(href) == origin.lower())
    return ~special & (same | ~absolute)


def checked_links(df: DataFrame, key: str, html: str, origin: str, limit: int | None = None) -> DataFrame:
    """The internal links an audit follows: all of a page, or the first ``limit``, without repeats.

    A limit is applied inside the row, before any shuffle.
    """
    hrefs = F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))
    first = F.filter(hrefs, lambda h: is_internal(h, origin))
    if limit is not None:
        first = F.slice(first, 1, limit)
    pairs = F.transform(first, lambda h: F.struct(h.alias("href"), normalized_link(h, origin).alias("target")))
    fresh = F.filter(
        pairs, lambda p, i: F.array_position(F.transform(pairs, lambda x: x["target"]), p["target"]) == i + 1
    )
    return df.select(key, F.posexplode(fresh).alias("link_no", "l")).select(key, "link_no", "l.href", "l.target")


def broken_links(links: DataFrame, crawl: DataFrame, url: str = "url", status: str = "status") -> DataFrame:
    """Checked links joined to the crawl table; ``status`` NULL means the target was never fetched.

    Link targets repeat heavily (every page links home), so they are reduced to distinct
    targets before the crawl join and only failing targets travel back.
    """
    known = crawl.select(F.regexp_replace(F.col(url), r"#[\s\S]*\z", "").alias("target"), F.col(status).alias("target_status"))
    bad = links.select("target").distinct().join(known, "target").where(F.col("target_status") >= 400)
    return links.join(bad, "target")


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """End of every enabled redirect chain of any length: ``from_path, to_path, hops, is_cycle``.

    Pointer doubling: a round joins the rows that still move to the table, so a chain of n hops takes
    log2(n) rounds. Where a row is n hops from its end, others are at every distance below; so a round
    that brings no row to an end leaves only rows that lead into a cycle. Those keep their own
    target and one hop. Lineage is cut between rounds. Of several rules for a path the one with the smallest target counts.
    """
    rules = redirects.where(F.coalesce(F.col("enabled"), F.lit(True))).groupBy("from_path").agg(F.min("to_path").alias("to_path"))
    starts = rules.select(F.col("from_path").alias("_s")).distinct()
    rows = rules.join(starts, F.col("to_path") == F.col("_s"), "left").select(
        "from_path", "to_path", F.lit(1).cast("long").alias("hops"), F.col("_s").isNull().alias("done"), F.col("to_path").alias("own")
    )
    rows = checkpoint(rows)
    ended = -1
    while (now := rows.where("done").count()) != ended:
        ended = now
        step = rows.select(F.col("from_path").alias("_f"), F.col("to_path").alias("_t"), F.col("hops").alias("_h"), F.col("done").alias("_d"))
        moved = rows.where("not done").join(step, F.col("to_path") == F.col("_f")).select(
            "from_path", F.col("_t").alias("to_path"), (F.col("hops") + F.col("_h")).alias("hops"), F.col("_d").alias("done"), "own"
        )
        rows = checkpoint(rows.where("done").union(moved))
    return rows.select(
        "from_path", F.when(F.col("done"), F.col("to_path")).otherwise(F.col("own")).alias("to_path"),
        F.when(F.col("done"), F.col("hops")).otherwise(1).cast("long").alias("hops"), (~F.col("done")).alias("is_cycle"),
    )


def redirect_paths(paths: DataFrame, path: str, resolved: DataFrame) -> DataFrame:
    """Paths with their final target; cycles and unknown paths stay where they are."""
    r = resolved.where(~F.col("is_cycle")).select(F.col("from_path").alias("_f"), F.col("to_path").alias("final_path"), "hops")
    joined = paths.join(r, F.col(path) == F.col("_f"), "left").drop("_f")
    return joined.withColumn("final_path", F.coalesce("final_path", F.col(path))).withColumn("hops", F.coalesce("hops", F.lit(0)))


def media_usage(references: DataFrame, url: str, media: DataFrame, public_url: str = "public_url") -> DataFrame:
    m = media.select(*[F.col(c).alias(f"media_{c}") if c in references.columns else F.col(c) for c in media.columns])
    right = f"media_{public_url}" if public_url in references.columns else public_url
    return references.join(m, references[url] == F.col(right), "left")


def unused_media(media: DataFrame, references: DataFrame, url: str, public_url: str = "public_url") -> DataFrame:
    used = references.select(F.col(url).alias("_u")).distinct()
    return media.join(used, F.col(public_url) == F.col("_u"), "left_anti")
