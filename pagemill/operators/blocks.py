"""Content blocks at h2 boundaries, and the filter for secondary blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import bound, nonblank, once, plain_text, squeeze_newlines, safe_start, squeezed_word_count, strip_long, strip_tags, strip_ws, tag_like, up_to, word_count, words

# Heading texts of secondary blocks, in matching order.
SECONDARY_HEADINGS = [
    (r"(?i)^(?:contact\s+us|contact\s+our|get\s+in\s+touch|reach\s+out)\z", "contact-widget"),
    (r"(?i)^(?:free\s+consultation|call\s+(?:us\s+)?now|get\s+help|schedule\s+(?:a\s+)?(?:consultation|appointment)|book\s+a)\z", "cta-block"),
    (r"(?i)^(?:recent\s+posts?|latest\s+posts?|related\s+posts?|popular\s+posts?|more\s+articles?)\z", "post-listing-widget"),
    (r"(?i)^(?:categories|archives|tags?|tag\s+cloud)\z", "sidebar-widget"),
    (r"(?i)^(?:about\s+the\s+author|author\s+bio)\z", "author-widget"),
    (r"(?i)^(?:newsletter|subscribe|sign\s+up)\z", "newsletter-widget"),
    (r"(?i)^(?:share\s+this|follow\s+us|social\s+media)\z", "social-widget"),
    (r"(?i)^(?:leave\s+a\s+(?:reply|comment)|comments?|discussion)\z", "comments-section"),
]
LOCATION_HEADING = r"(?i)^in\s+[A-Z][a-z]+(?:\s*(?:&|and)\s*[A-Z][a-z]+)?\z"
PHONE_SHAPE = r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"
STREET_SHAPE = r"(?i)\d+\s+[A-Z][a-z]+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl)\b"
STATE_ZIP_SHAPE = r"\b[A-Z]{2}\s+\d{5}\b"
FORM_PARTS = [
    r"(?i)<input\b", r"(?i)<textarea\b", r"(?i)<select\b", r"""(?i)<button\b[^>]*type=["']submit["']""",
    r"(?i)nf-form", r"(?i)wpcf7", r"(?i)wpforms", r"(?i)nf-form-cont", r"(?i)gform_wrapper",
]
SUB_HEADING = r"(?i)<h[3-6]\b"
# Characters of a block that mostly hold the words it needs to stay.
SURE_CHARS = 1000
LINK = r"(?is)<a\b[^>]*>.*?</a>"


@dataclass
class FilterOptions:
    """How secondary blocks are recognised for a template.

    ``extra_headings`` are patterns added to the built-in list. ``detectors`` take the heading
    and the block's html as Columns and give a reason Column, NULL for no verdict.
    """

    template: str = ""
    extra_headings: list[str] = field(default_factory=list)
    detectors: list[Callable[[Column, Column], Column]] = field(default_factory=list)
    remove_contact: bool | None = None

    @property
    def drops_contact(self) -> bool:
        return self.template == "practice" if self.remove_contact is None else self.remove_contact


@bound
def heading_reason(heading: Column, options: FilterOptions | None = None) -> Column:
    """Why a heading marks secondary content, NULL when it does not."""
    return once(strip_ws(heading), lambda h: _heading_reason(h, options or FilterOptions()))


def _heading_reason(h: Column, options: FilterOptions) -> Column:
    out = F.when(F.coalesce(h, F.lit("")) == "", F.lit(None).cast("string"))
    for pattern, reason in SECONDARY_HEADINGS:
        out = out.when(h.rlike(pattern), reason)
    for pattern in options.extra_headings:
        out = out.when(h.rlike(pattern), "custom-secondary")
    return out.when(h.rlike(LOCATION_HEADING), "location-heading")


def _block(html: Column, level: Column, heading: Column) -> Column:
    return once(
        F.struct(html.alias("html"), level.alias("level"), heading.alias("heading"), plain_text(html).alias("plain")),
        lambda b: F.struct(
            b["html"].alias("html"), b["heading"].alias("heading"), b["level"].alias("level"),
            b["plain"].alias("plain"), squeezed_word_count(b["plain"]).alias("words"),
        ),
    )


@bound
def content_blocks(html: Column) -> Column:
    """``array<struct<html, heading, level, plain, words>>``: intro, then one block per h2."""
    return F.transform(_pieces(html), lambda p: once(_heading(p), lambda h: _block(p, h["level"], h["heading"])))


def _pieces(html: Column) -> Column:
    """A body cut at its h2."""
    several = F.filter(F.transform(F.split(html, r"(?i)(?=<h2\b[^>]*>)"), strip_long), lambda p: p != "")
    return F.when(html.rlike(r"(?i)<h2\b[^>]*>"), several).otherwise(F.array(html))


def _heading(piece: Column) -> Column:
    is_h2 = piece.rlike(r"(?i)^<h2\b[^>]*>")
    heading = F.when(is_h2, strip_ws(strip_tags(F.regexp_extract(piece, r"(?is)<h2\b[^>]*>(.*?)</h2>", 1)))).otherwise("")
    return F.struct(F.when(is_h2, 2).otherwise(0).alias("level"), heading.alias("heading"))


def _surely_stays(piece: Column, h: Column, options: FilterOptions) -> Column:
    """Whether the start of a block tells that the first keep rules of ``_judge`` hold, and that no sub-section could go."""
    n = squeezed_word_count(plain_text(safe_start(piece, SURE_CHARS)))
    paragraph = rf"(?is)^<h2\b[^>]*>[^<]*</h2>\s*<p\b[^>]*>.{{20}}{up_to('/p>')}"
    section = (h["level"] == 2) & (n >= 50) & heading_reason(h["heading"], options).isNull() & piece.rlike(paragraph)
    return (((h["level"] == 0) & (n > 10)) | section) & ~_has_sub_heading(piece)


def _has_sub_heading(html: Column) -> Column:
    return tag_like(html, SUB_HEADING, "<h3", "<h4", "<h5", "<h6")


def is_form_block(html: Column) -> Column:
    total = F.lit(0)
    for part in FORM_PARTS:
        total = total + F.regexp_count(html, F.lit(part))
    return html.rlike(r"(?i)<form\b") | (total >= 2)


def is_contact_block(html: Column, plain: Column, n_words: Column) -> Column:
    phone = plain.rlike(PHONE_SHAPE) | html.rlike("(?i)tel:")
    address = plain.rlike(STREET_SHAPE) | plain.rlike(STATE_ZIP_SHAPE)
    card = html.rlike(r"(?i)\.vcf|vcard")
    signals = phone.cast("int") + html.rlike("(?i)mailto:").cast("int") + address.cast("int") + card.cast("int")
    return (n_words <= 100) & (signals >= 2)


def link_words(html: Column) -> Column:
    links = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))
    return word_count(F.array_join(F.transform(links, strip_tags), " "))


def is_link_dense(html: Column, n_words: Column) -> Column:
    n_links = F.regexp_count(html, F.lit(LINK))
    dense = once(link_words(html), lambda linked: (n_words - linked < 50) & (linked / n_words > 0.6))
    return (n_words >= 5) & (n_links > 3) & dense


@bound
def _item_is_link(item: Column) -> Column:
    full = strip_ws(strip_tags(item))
    links = F.regexp_extract_all(item, F.lit(LINK), F.lit(0))
    linked = strip_ws(F.array_join(F.transform(links, strip_tags), " "))
    return (full != "") & (F.size(links) > 0) & (F.length(linked) / F.length(full) >= 0.6)


def is_post_listing(html: Column) -> Column:
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<(ul|ol)\b[^>]*>(.*?)</\1>"), F.lit(2))

    def link_list(body: Column) -> Column:
        items = F.regexp_extract_all(body, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
        return (F.size(items) >= 3) & (F.size(F.filter(items, _item_is_link)) >= 3)

    articles = F.regexp_count(html, F.lit(r"(?i)<article\b"))
    return (articles >= 2) | html.rlike(r"(?i)<article\b[^>]*\bpost-\d+\b") | F.exists(lists, link_list)


def _sub_heading_reason(html: Column, options: FilterOptions) -> Column:
    texts = F.regexp_extract_all(html, F.lit(r"(?is)<h([3-6])\b[^>]*>(.*?)</h\1>"), F.lit(2))
    reasons = F.transform(texts, lambda t: heading_reason(strip_tags(t), options))
    return F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))


def secondary_reason(block: Column, options: FilterOptions | None = None) -> Column:
    """Why a block is secondary, NULL when it stays. Keep rules come first."""
    options = options or FilterOptions()
    return once(heading_reason(block["heading"], options), lambda h: _judge(block, h, options))


def _judge(block: Column, by_heading: Column, options: FilterOptions) -> Column:
    html, plain, n = block["html"], block["plain"], block["words"]
    heading, level = block["heading"], block["level"]
    after = F.regexp_replace(html, r"(?is)^(.*?)<h2\b[^>]*>.*?</h2>", "$1")
    substantial = (level == 2) & (n >= 50) & after.rlike(rf"(?is)<p\b[^>]*>.{{20}}{up_to('/p>')}")
    stays = (
        ((level == 0) & (n > 10))
        | (substantial & (by_heading.isNull() | (F.length(plain_text(after)) > 200)))
        | (F.endswith(heading, F.lit("?")) & (n > 15))
        | (html.rlike(r"(?i)<h3\b[^>]*>[^<]*\?</h3>\s*<p\b") & (n > 30))
    )
    callable_cta = html.rlike(r"(?i)<a\b") | plain.rlike(PHONE_SHAPE)
    out = F.when(F.coalesce(stays, F.lit(False)), F.lit(None).cast("string")).when(is_form_block(html), "form-block")
    if options.drops_contact:
        out = out.when(is_contact_block(html, plain, n), "contact-location-block")
    out = (
        out.when((by_heading == "cta-block") & (n < 100) & callable_cta, "cta-block")
        .when(is_link_dense(html, n), "high-link-density")
        .when(is_post_listing(html), "post-listing")
        .when(by_heading.isNotNull() & (by_heading != "cta-block") & (n < 150), by_heading)
        .when((level == 0) & (n < 150) & _sub_heading_reason(html, options).isNotNull(), _sub_heading_reason(html, options))
    )
    if options.detectors:
        out = out.otherwise(F.coalesce(*[d(heading, html) for d in options.detectors]))
    return out


def _snippet(html: Column) -> Column:
    return F.substring(plain_text(html), 1, 120)


@bound
def strip_sub_sections(html: Column, options: FilterOptions | None = None) -> Column:
    """Cut h3–h6 sub-sections with a secondary heading: ``struct<html, removed>``.

    A sub-section runs to the next heading of the same or a higher level.
    """
    options = options or FilterOptions()
    removed_type = "array<struct<reason:string,snippet:string>>"
    start = F.struct(
        F.lit("").alias("html"), F.array().cast(removed_type).alias("removed"), F.lit(0).alias("cover")
    )

    def describe(p: Column) -> Column:
        level = F.coalesce(F.regexp_extract(p, r"(?i)^<h([1-6])\b", 1).try_cast("int"), F.lit(0))
        title = F.regexp_extract(p, r"(?is)^<h([3-6])\b[^>]*>(.*?)</h\1>", 2)
        return F.struct(p.alias("html"), level.alias("level"), heading_reason(strip_tags(title), options).alias("reason"))

    def step(state: Column, p: Column) -> Column:
        covered = (state["cover"] > 0) & (p["level"] > state["cover"])
        starts = ~covered & p["reason"].isNotNull()
        return (
            F.when(covered, state)
            .when(
                starts,
                F.struct(
                    state["html"].alias("html"),
                    F.concat(
                        state["removed"],
                        F.array(F.struct(p["reason"].alias("reason"), _snippet(F.substring(p["html"], 1, 150)).alias("snippet"))),
                    ).alias("removed"),
                    p["level"].alias("cover"),
                ),
            )
            .otherwise(F.struct(F.concat(state["html"], p["html"]).alias("html"), state["removed"].alias("removed"), F.lit(0).alias("cover")))
        )

    parts = F.transform(F.split(html, r"(?i)(?=<h[1-6]\b[^>]*>)"), describe)
    cut = F.aggregate(
        parts, start, step,
        lambda s: F.struct(
            F.when(F.size(s["removed"]) > 0, squeeze_newlines(s["html"])).otherwise(html).alias("html"),
            s["removed"].alias("removed"),
        ),
    )
    # Only headings of these levels give a reason.
    whole = F.struct(html.alias("html"), F.array().cast(removed_type).alias("removed"))
    return F.when(_has_sub_heading(html), cut).when(html.isNotNull(), whole)


@bound
def filter_secondary(html: Column, options: FilterOptions | None = None) -> Column:
    """``struct<html, removed array<struct<reason, snippet>>>``; a page is never emptied."""
    options = options or FilterOptions()

    def trim_block(b: Column) -> Column:
        return once(
            strip_sub_sections(b["html"], options),
            lambda s: F.struct(
                F.when(F.size(s["removed"]) > 0, _block(s["html"], b["level"], b["heading"])).otherwise(b).alias("block"),
                s["removed"].alias("removed"),
            ),
        )

    def judge(t: Column) -> Column:
        return F.struct(t["block"]["html"].alias("html"), t["removed"].alias("removed"), secondary_reason(t["block"], options).alias("reason"))

    def look(p: Column, h: Column) -> Column:
        sure = F.struct(p.alias("html"), F.array().cast("array<struct<reason:string,snippet:string>>").alias("removed"), F.lit(None).cast("string").alias("reason"))
        judged = once(_block(p, h["level"], h["heading"]), lambda b: once(trim_block(b), judge))
        return F.when(F.coalesce(_surely_stays(p, h, options), F.lit(False)), sure).otherwise(judged)

    def assemble(judged: Column) -> Column:
        kept = F.filter(judged, lambda t: t["reason"].isNull())
        dropped = F.transform(
            F.filter(judged, lambda t: t["reason"].isNotNull()),
            lambda t: F.struct(t["reason"].alias("reason"), _snippet(t["html"]).alias("snippet")),
        )
        subs = F.flatten(F.transform(judged, lambda t: t["removed"]))
        text = squeeze_newlines(F.array_join(F.transform(kept, lambda t: t["html"]), "\n"))
        return F.when(
            F.size(kept) > 0, F.struct(text.alias("html"), F.concat(subs, dropped).alias("removed"))
        ).otherwise(F.struct(html.alias("html"), F.array().cast("array<struct<reason:string,snippet:string>>").alias("removed")))

    filtered = once(F.transform(_pieces(html), lambda p: once(_heading(p), lambda h: look(p, h))), assemble)
    untouched = F.struct(html.alias("html"), F.array().cast("array<struct<reason:string,snippet:string>>").alias("removed"))
    return F.when(nonblank(html), filtered).otherwise(untouched)


def block_table(df: DataFrame, key: str, html: str) -> DataFrame:
    """One row per content block: ``key, block_no, heading, level, plain, words, html``."""
    return df.where(nonblank(F.col(html))).select(key, F.posexplode(content_blocks(F.col(html))).alias("block_no", "b")).select(
        key, "block_no", "b.heading", "b.level", "b.plain", "b.words", "b.html"
    )


__all__ = [
    "FilterOptions", "heading_reason", "content_blocks", "is_form_block", "is_contact_block", "link_words",
    "is_link_dense", "is_post_listing", "secondary_reason", "strip_sub_sections", "filter_secondary",
    "block_table", "once", "words",
]
