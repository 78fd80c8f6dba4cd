"""Lead tracking: URL parameters, first-touch landing page, phone numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.phones import format_variants, primary_format, sync_digits, sync_phones
from pagemill.functions.text import once, null_if_blank, plain_text, replace_first, strip_ws
from pagemill.functions.html import strip_page_shell
from pagemill.functions.urls import TRACKING_PARAMS, query_param

TEL_LINK = r"""(?is)<a\b[^>]*\bhref=["'](tel:[^"']*)["'][^>]*>(.*?)</a>"""


def tracking_payload(current: Column, landing: Column, referrer: Column) -> list[Column]:
    """The thirteen tracking columns of a submission; blank where unknown."""
    here = F.coalesce(strip_ws(current), F.lit(""))
    return [
        *[query_param(here, p).alias(p) for p in TRACKING_PARAMS],
        F.coalesce(null_if_blank(strip_ws(landing)), here).alias("landing_page"),
        here.alias("submission_page"),
        F.coalesce(strip_ws(referrer), F.lit("")).alias("referrer"),
    ]


def first_touch(df: DataFrame, session: str, url: str, at: str, tie: str) -> DataFrame:
    """First non-blank URL of each session. ``min_by`` reduces before the shuffle."""
    seen = df.where(null_if_blank(F.col(url)).isNotNull())
    return seen.groupBy(session).agg(F.min_by(F.col(url), F.struct(at, tie)).alias("landing_page"), F.min(at).alias("first_seen"))


def with_landing_page(submissions: DataFrame, touches: DataFrame, session: str) -> DataFrame:
    return submissions.join(touches.select(session, "landing_page"), session, "left")


def tel_numbers(html: Column) -> Column:
    hrefs = F.regexp_extract_all(html, F.lit(TEL_LINK), F.lit(1))
    return F.filter(F.transform(hrefs, sync_digits), lambda d: d != "")


def text_numbers(html: Column) -> Column:
    """Numbers in running text; link texts of tel links do not count."""
    return sync_phones(plain_text(F.regexp_replace(strip_page_shell(html), TEL_LINK, " ")))


def _with_numbers(df: DataFrame, html: str) -> DataFrame:
    """``df`` and ``_numbers``: one entry per number of a page, counted inside the row."""
    found = F.struct(tel_numbers(F.col(html)).alias("links"), text_numbers(F.col(html)).alias("texts"))

    def counted(v: Column) -> Column:
        links, texts = v["links"], v["texts"]

        def times(numbers: Column, d: Column) -> Column:
            return F.size(F.filter(numbers, lambda x: x == d)).cast("long")

        def first(numbers: Column, d: Column) -> Column:
            at = F.array_position(numbers, d)
            return F.when(at > 0, (at - 1).cast("int"))

        return F.transform(
            F.array_distinct(F.concat(links, texts)),
            lambda d: F.struct(
                d.alias("digits"), times(links, d).alias("in_links"), times(texts, d).alias("in_text"),
                first(links, d).alias("first_link"), first(texts, d).alias("first_text"),
            ),
        )

    return df.withColumn("_numbers", once(found, counted))


def phone_counts(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, digits, in_links, in_text, first_link, first_text``: one row per number and page."""
    return _with_numbers(df.select(key, html), html).select(key, F.inline("_numbers"))


def phone_mapping(counts: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """``key, original_digits, swapped_digits`` from a table of ``phone_counts``; see ``page_mapping``. A page's numbers are few."""
    gathered = F.collect_list(F.struct("digits", "in_links", "in_text", "first_link", "first_text")).alias("_numbers")
    return _mapping(counts.groupBy(key).agg(gathered), key, known, [key])


def page_mapping(df: DataFrame, key: str, html: str, known: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``key, original_digits, swapped_digits``: which number stands for which, per page, inside the row.

    Two or more linked numbers: a known original, else the linked number most frequent in the
    text, else whatever differs from the last swapped number, else the most linked one. One
    linked number: the text number that differs from it. ``known(key, originals, last_swapped)``
    is the state of earlier runs. With ``keep`` all pages stay, with these columns, and unmapped numbers are NULL.
    """
    return _mapping(_with_numbers(df, html), key, known, keep or [key], all_pages=keep is not None)


def _mapping(pages: DataFrame, key: str, known: DataFrame | None, keep: list[str], all_pages: bool = False) -> DataFrame:
    def order(n: Column) -> Column:
        return F.struct(n["first_link"].alias("first_link"), n["digits"].alias("digits"), n["in_links"].alias("in_links"), n["in_text"].alias("in_text"))

    def rank(n: Column) -> Column:
        return F.struct((-n["in_text"]).alias("rank"), n["first_text"].alias("first_text"), n["digits"].alias("digits"))

    pages = pages.select(
        *[F.col(f"`{c}`") for c in keep],
        once(F.col("_numbers"), lambda v: F.struct(
            F.array_sort(F.transform(F.filter(v, lambda n: n["in_links"] > 0), order)).alias("links"),
            F.array_sort(F.transform(F.filter(v, lambda n: n["in_text"] > 0), rank)).alias("texts"),
        )).alias("_sorted"),
    )
    # Generated rows keep Spark from writing the whole expression out again at every use of it.
    pages = pages.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array("_sorted")).alias("_s")).select(*[F.col(f"`{c}`") for c in keep], "_s.links", "_s.texts")
    pages = pages if all_pages else pages.where(F.size("links") > 0)
    if known is not None:
        pages = pages.join(known.select(key, "originals", "last_swapped"), key, "left")
    else:
        pages = pages.withColumn("originals", F.array().cast("array<string>")).withColumn("last_swapped", F.lit(None).cast("string"))
    last = F.coalesce("last_swapped", F.lit(""))
    originals = F.coalesce("originals", F.array().cast("array<string>"))
    links = F.col("links")

    def first_digits(arr: Column) -> Column:
        return F.get(arr, F.lit(0))["digits"]

    def by_rank(arr: Column, rank) -> Column:
        return F.array_sort(F.transform(arr, lambda l: F.struct(rank(l).alias("rank"), l["first_link"].alias("first_link"), l["digits"].alias("digits"))))

    known_link = first_digits(F.filter(links, lambda l: F.array_contains(originals, l["digits"]) & (l["digits"] != last)))
    in_text = first_digits(by_rank(F.filter(links, lambda l: l["in_text"] > 0), lambda l: -l["in_text"]))
    other = F.when(
        F.exists(links, lambda l: l["digits"] == last), first_digits(F.filter(links, lambda l: l["digits"] != last))
    )
    most = first_digits(by_rank(links, lambda l: -l["in_links"]))
    original_many = F.coalesce(known_link, in_text, other, most)
    only = first_digits(links)
    text_other = first_digits(F.filter("texts", lambda t: t["digits"] != only))
    known_other = F.when(only == last, F.get(F.filter(originals, lambda d: d != only), F.lit(0)))
    many = F.size(links) >= 2
    chosen = pages.select(*keep, "links", last.alias("last"), F.when(many, original_many).otherwise(F.coalesce(text_other, known_other)).alias("original_digits"), many.alias("many"), only.alias("only"))
    rest = F.filter("links", lambda l: l["digits"] != F.col("original_digits"))
    swapped = F.when(F.exists(rest, lambda l: l["digits"] == F.col("last")), F.col("last")).otherwise(first_digits(rest))
    original, swap = F.col("original_digits"), F.when(F.col("many"), swapped).otherwise(F.col("only"))
    found = chosen.select(*keep, original, swap.alias("swapped_digits"))
    good = F.coalesce(original != F.col("swapped_digits"), F.lit(False))
    if not all_pages:
        return found.where(good)
    return found.select(*keep, F.when(good, original).alias("original_digits"), F.when(good, F.col("swapped_digits")).alias("swapped_digits"))


def rewrite_phones(text: Column, original: Column, swapped: Column) -> Column:
    """Each written form of the original number, first occurrence, to the swapped number."""
    return F.aggregate(format_variants(original), text, lambda acc, v: replace_first(acc, v, primary_format(swapped)))


def rewrite_page(html: Column, original: Column, swapped: Column) -> Column:
    """Tel links to the swapped number, and the number in every text between tags."""
    linked = F.regexp_replace(html, F.lit(r"""(?i)(<a\b[^>]*\bhref=["'])tel:[^"']*"""), F.concat(F.lit("$1tel:"), swapped))
    pieces = F.split(linked, r"(?=<)|(?<=>)")
    return F.array_join(
        F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(rewrite_phones(p, original, swapped))), ""
    )


def sync_pages(df: DataFrame, key: str, html: str, known: DataFrame | None = None) -> DataFrame:
    """``df`` with each page's original number swapped; without ``known`` nothing is shuffled."""
    joined = page_mapping(df, key, html, known, keep=df.columns)
    new = F.when(F.col("original_digits").isNotNull(), rewrite_page(F.col(html), F.col("original_digits"), F.col("swapped_digits"))).otherwise(F.col(html))
    return joined.withColumn(html, new).select(*df.columns)
