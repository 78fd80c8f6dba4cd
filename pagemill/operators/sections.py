"""Sections, FAQ items and images of a body: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.html import IMG_PATTERN, strip_h1
from pagemill.functions.text import (
    WS, bound, ensure_html, nonblank, once, replace_first, safe_start, squeeze, squeeze_newlines, strip_long, strip_tags, strip_ws, tag_like, up_to, word_count,
)

SECTION_TYPE = "array<struct<body:string,image:string,imageAlt:string,imagePosition:string,showCTAs:boolean>>"
FAQ_TYPE = "array<struct<question:string,answer:string>>"
GROUP_WORDS = 400
SHORT_PARAGRAPH_WORDS = 50
LONG_BODY_CHARS = 500

# Question markup and FAQ headings.
DT_DD = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
H3_ANSWER = r"(?is)<h3[^>]*>(.*?)</h3>(.*?)(?=<h3|<h2|</section|</div|\z)"
STRONG_ANSWER = r"(?is)<(?:strong|b)[^>]*>(.*?\?)\s*</(?:strong|b)>\s*(.*?)(?=<(?:strong|b)|<h[2-6]|\z)"
FAQ_HEADING = (
    r"(?i)<h2[^>]*>\s*(?:frequently\s+asked\s+questions|faq|faqs|common\s+questions|q\s*(?:&amp;|&)\s*a"
    r"|questions\s*(?:&amp;|&|and)\s*answers)\s*</h2>"
)
BLOCK_TAGS = "p|div|ul|ol|dl|table|blockquote|figure|section|article|h[1-6]|hr|pre"


@bound
def split_on_h2(html: Column) -> Column:
    """One section per h2; the intro joins the first section; without h2 one section."""

    def merge(pieces: Column) -> Column:
        first = F.get(pieces, F.lit(0))
        has_intro = ~first.rlike(r"(?i)^<h2[\s>]") & (F.size(pieces) > 1)
        joined = F.concat(
            F.array(F.concat(strip_long(first), strip_long(F.get(pieces, F.lit(1))))),
            F.slice(pieces, F.lit(3), F.size(pieces)),
        )
        return F.when(has_intro, joined).otherwise(pieces)

    merged = F.transform(once(F.split(html, r"(?i)(?=<h2[\s>])"), merge), strip_long)
    return F.when(nonblank(html), F.filter(merged, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def _entity_free(c: Column) -> Column:
    return squeeze(F.regexp_replace(strip_tags(c, " "), "(?i)&[a-z]+;", " "))


def _shorter(c: Column, n: int) -> Column:
    """Whether the text of a section has fewer than ``n`` characters; mostly its start tells."""
    return F.when(F.length(_entity_free(safe_start(c, 500))) >= n, F.lit(False)).otherwise(F.length(_entity_free(c)) < n)


@bound
def is_thin_section(s: Column) -> Column:
    """Too little text, or no block beyond a heading."""

    def has(tags: str) -> Column:
        return s.rlike(rf"(?is)<(?:{tags})\b[^>]*>{up_to(f'/(?:{tags})>')}")

    rich = s.rlike(r"(?i)<(?:ul|ol|table|blockquote)\b") & (has("ul|ol") | has("table") | has("blockquote"))
    body = F.regexp_replace(s, r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>", "")
    return _shorter(s, 50) | (~rich & (~has("p") | once(body, lambda b: _shorter(b, 30))))


@bound
def drop_thin_sections(sections: Column) -> Column:
    kept = F.filter(sections, lambda s: ~is_thin_section(s))
    return once(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(sections))


def top_level_blocks(html: Column) -> Column:
    """``array<struct<html, tag, words>>`` of top-level elements; loose text is tag ``text``.

    A fold over the tag pieces finds where each block starts; a piece belongs to the open
    element until its closing tag brings the depth back to zero.
    """
    pieces = F.split(html, rf"(?i)(?=</?(?:{BLOCK_TAGS})[\s/>])|(?<=>)")
    shape = rf"(?i)^<(/?)({BLOCK_TAGS})[\s/>]"

    def describe(p: Column) -> Column:
        return F.struct(
            p.alias("p"),
            F.lower(F.regexp_extract(p, shape, 2)).alias("tag"),
            (F.regexp_extract(p, shape, 1) == "/").alias("closes"),
            nonblank(p).alias("filled"),
        )

    start_type = "array<struct<at:int,tag:string>>"
    zero = F.struct(
        F.array().cast(start_type).alias("starts"), F.lit(0).alias("depth"), F.lit("").alias("tag"),
        F.lit(False).alias("loose"), F.lit(0).alias("i"),
    )

    def step(s: Column, t: Column) -> Column:
        top = s["depth"] == 0
        opens = (t["tag"] != "") & ~t["closes"]
        begin = F.concat(s["starts"], F.array(F.struct((s["i"]).alias("at"), F.when(opens, t["tag"]).otherwise("text").alias("tag"))))
        same = t["tag"] == s["tag"]
        nxt = (s["i"] + 1).alias("i")
        return (
            F.when(
                top & opens & (t["tag"] == "hr"),
                F.struct(begin.alias("starts"), F.lit(0).alias("depth"), F.lit("").alias("tag"), F.lit(False).alias("loose"), nxt),
            )
            .when(
                top & opens,
                F.struct(begin.alias("starts"), F.lit(1).alias("depth"), t["tag"].alias("tag"), F.lit(False).alias("loose"), nxt),
            )
            .when(
                top & ~s["loose"] & t["filled"],
                F.struct(begin.alias("starts"), F.lit(0).alias("depth"), F.lit("").alias("tag"), F.lit(True).alias("loose"), nxt),
            )
            .when(
                ~top & same,
                F.struct(
                    s["starts"].alias("starts"),
                    F.when(t["closes"], s["depth"] - 1).otherwise(s["depth"] + 1).alias("depth"),
                    s["tag"].alias("tag"), F.lit(False).alias("loose"), nxt,
                ),
            )
            .otherwise(F.struct(s["starts"].alias("starts"), s["depth"].alias("depth"), s["tag"].alias("tag"), s["loose"].alias("loose"), nxt))
        )

    def cut(ps: Column) -> Column:
        starts = F.aggregate(ps, zero, step, lambda s: s["starts"])
        return once(
            starts,
            lambda st: F.transform(
                st,
                lambda b, i: once(
                    strip_ws(
                        F.array_join(
                            F.transform(
                                F.slice(ps, b["at"] + 1, F.coalesce(F.get(st, i + 1)["at"], F.size(ps)) - b["at"]),
                                lambda x: x["p"],
                            ),
                            "",
                        )
                    ),
                    lambda h: F.struct(
                        h.alias("html"), b["tag"].alias("tag"),
                        F.when(b["tag"] == "hr", 0).otherwise(word_count(strip_tags(h))).alias("words"),
                    ),
                ),
            ),
        )

    return once(F.transform(pieces, describe), cut)


def group_blocks(blocks: Column, html: Column) -> Column:
    """Join top-level blocks to sections of about 400 words.

    No cut after a heading, nor between a short paragraph and the list it introduces.
    """
    zero = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("i")
    )

    def step(s: Column, b: Column) -> Column:
        text, n = F.concat(s["cur"], b["html"]), s["n"] + b["words"]
        nxt = F.get(blocks, s["i"] + 1)
        last = s["i"] + 1 == F.size(blocks)
        heading = b["tag"].rlike("^h[1-6]$")
        intro = nxt["tag"].isin("ul", "ol", "dl") & (b["tag"] == "p") & (b["words"] < SHORT_PARAGRAPH_WORDS)
        cut = last | ((n >= GROUP_WORDS) & ~heading & ~F.coalesce(intro, F.lit(False)))
        return F.when(
            cut,
            F.struct(F.concat(s["out"], F.array(text)).alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), (s["i"] + 1).alias("i")),
        ).otherwise(F.struct(s["out"].alias("out"), text.alias("cur"), n.alias("n"), (s["i"] + 1).alias("i")))

    total = F.aggregate(blocks, F.lit(0), lambda a, b: a + b["words"])
    grouped = F.filter(F.aggregate(blocks, zero, step, lambda s: s["out"]), nonblank)
    return F.when((F.size(blocks) == 0) | (total < GROUP_WORDS), F.array(strip_ws(html))).otherwise(grouped)


@bound
def split_by_paragraphs(html: Column) -> Column:
    grouped = once(top_level_blocks(html), lambda b: group_blocks(b, html))
    return F.when(nonblank(html), grouped).otherwise(F.array().cast("array<string>"))


@bound
def split_sections(html: Column) -> Column:
    """h2 sections, or paragraph groups when a long body has no h2."""
    return once(
        split_on_h2(html),
        lambda s: F.when((F.size(s) <= 1) & (F.length(html) > LONG_BODY_CHARS), split_by_paragraphs(html)).otherwise(s),
    )


def _pairs(html: Column, pattern: str) -> Column:
    zipped = F.zip_with(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)),
        lambda q, a: F.struct(strip_ws(strip_tags(q)).alias("question"), strip_ws(a).alias("answer")),
    )
    return F.filter(zipped, lambda p: (p["question"] != "") & (p["answer"] != ""))


def dl_faq(html: Column) -> Column:
    return _pairs(html, DT_DD)


def h3_faq(html: Column) -> Column:
    return F.filter(_pairs(html, H3_ANSWER), lambda p: F.endswith(p["question"], F.lit("?")))


def strong_faq(html: Column) -> Column:
    return _pairs(html, STRONG_ANSWER)


@bound
def detect_faq(html: Column) -> Column:
    """FAQ pairs from a definition list or h3 questions; fewer than two is none."""
    none = F.array().cast(FAQ_TYPE)
    by_h3 = once(h3_faq(html), lambda p: F.when(F.size(p) >= 2, p).otherwise(none))
    found = once(dl_faq(html), lambda p: F.when(F.size(p) >= 2, p).otherwise(by_h3))
    return F.coalesce(F.when(tag_like(html, "(?i)<(?:dt|h3)", "<d", "<h3"), found), none)


@bound
def extract_faq(html: Column) -> Column:
    """As ``detect_faq``, then bold questions; a single bold pair counts."""
    bold = strong_faq(html)
    by_h3 = once(h3_faq(html), lambda p: F.when(F.size(p) >= 2, p).otherwise(bold))
    found = once(dl_faq(html), lambda p: F.when(F.size(p) >= 2, p).otherwise(by_h3))
    return F.transform(found, lambda p: F.struct(p["question"].alias("question"), ensure_html(p["answer"]).alias("answer")))


def remove_faq(html: Column, items: Column) -> Column:
    """Take extracted FAQ items out of the body, with their headings."""
    filled = F.filter(items, lambda p: (p["question"] != "") & (p["answer"] != ""))
    return once(F.struct(html.alias("h"), filled.alias("u")), lambda v: _without_faq(v["h"], v["u"]))


def _without_faq(html: Column, used: Column) -> Column:
    def without_lists(c: Column) -> Column:
        lists = F.regexp_extract_all(c, F.lit(r"(?is)<dl[^>]*>.*?</dl>"), F.lit(0))
        hit = F.filter(lists, lambda d: F.exists(used, lambda p: F.contains(strip_tags(d), p["question"])))
        return F.aggregate(hit, c, lambda acc, d: F.replace(acc, d, F.lit("")))

    def is_answered(piece: Column) -> Column:
        title = F.regexp_extract(piece, r"(?is)^<h3[^>]*>(.*?)</h3>", 1)
        plain = strip_ws(strip_tags(piece))

        def matches(p: Column) -> Column:
            answer = strip_ws(strip_tags(p["answer"]))
            at = F.instr(plain, p["question"])
            rest = F.substring(plain, at + F.length(p["question"]), F.length(plain))
            return F.contains(title, p["question"]) & (at > 0) & (answer != "") & F.contains(rest, answer)

        return (title != "") & F.exists(used, matches)

    def without_h3(c: Column) -> Column:
        pieces = F.split(c, r"(?i)(?=<h[2-6]|<div|<section|<article|<footer|<aside)")
        return F.array_join(F.filter(pieces, lambda p: ~is_answered(p)), "")

    def without_bold(c: Column) -> Column:
        shape = rf"(?is)<(?:p|div)[^>]*>{WS}*<(?:strong|b)[^>]*>{WS}*([^<]*?\?){WS}*</(?:strong|b)>.*?</(?:p|div)>"
        hits = F.zip_with(
            F.regexp_extract_all(c, F.lit(shape), F.lit(0)), F.regexp_extract_all(c, F.lit(shape), F.lit(1)),
            lambda whole, q: F.struct(whole.alias("whole"), q.alias("q")),
        )
        known = F.filter(hits, lambda h: F.exists(used, lambda p: p["question"] == h["q"]))
        return F.aggregate(known, c, lambda acc, h: F.replace(acc, h["whole"], F.lit("")))

    def tidy(c: Column) -> Column:
        c = F.regexp_replace(c, rf"(?i)<(p|div|section)\b[^>]*>(?:{WS}++|&nbsp;)*+</\1>", "")
        return squeeze_newlines(c)

    cleaned = once(
        html,
        lambda a: once(without_lists(a), lambda b: once(
            F.regexp_replace(without_h3(b), FAQ_HEADING, ""), lambda c: tidy(without_bold(c)))),
    )
    return F.when((F.size(used) > 0) & (html != ""), cleaned).otherwise(html)


def clean_body(html: Column, items: Column | None = None) -> Column:
    """Body as html without h1, and without the given FAQ items."""
    base = strip_h1(ensure_html(html))
    return base if items is None else once(base, lambda b: remove_faq(b, items))


def section_struct(i: Column, body: Column, image: Column, alt: Column, position: Column, ctas: Column) -> Column:
    """A section with its defaults by position: even right with calls to action, odd left without."""
    even = i % 2 == 0
    return F.struct(
        F.coalesce(body, F.lit("")).alias("body"),
        F.coalesce(image, F.lit("")).alias("image"),
        F.coalesce(alt, F.lit("")).alias("imageAlt"),
        F.coalesce(position, F.when(even, "right").otherwise("left")).alias("imagePosition"),
        F.coalesce(ctas, even).alias("showCTAs"),
    )


def sections_from_bodies(bodies: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(bodies, lambda b, i: section_struct(i, b, none, none, none, F.lit(None).cast("boolean")))


def normalize_sections(sections: Column) -> Column:
    return F.transform(
        F.coalesce(sections, F.array().cast(SECTION_TYPE)),
        lambda s, i: section_struct(i, s["body"], s["image"], s["imageAlt"], s["imagePosition"], s["showCTAs"]),
    )


@bound
def extract_image(body: Column) -> Column:
    """First image of a body: ``struct<body, image, imageAlt>``, its figure or paragraph wrapper removed."""
    bare = F.struct(body.alias("body"), F.lit("").alias("image"), F.lit("").alias("imageAlt"))
    return F.when(F.coalesce(tag_like(body, "(?i)<img", "<i"), F.lit(True)), _with_image(body)).otherwise(bare)


def _with_image(body: Column) -> Column:
    img = F.regexp_extract(body, IMG_PATTERN, 0)
    inner = IMG_PATTERN.replace("(?i)", "").replace("([^", "(?:[^")
    figure = rf"(?is)<figure[^>]*>{WS}*({inner}){WS}*(?:<figcaption[^>]*>.*?</figcaption>{WS}*)?</figure>"
    para = rf"(?is)<p[^>]*>{WS}*({inner}){WS}*</p>"
    rest = (
        F.when(F.regexp_extract(body, figure, 1) == img, replace_first(body, F.regexp_extract(body, figure, 0), F.lit("")))
        .when(F.regexp_extract(body, para, 1) == img, replace_first(body, F.regexp_extract(body, para, 0), F.lit("")))
        .otherwise(replace_first(body, img, F.lit("")))
    )
    return F.struct(
        F.when(img == "", body).otherwise(strip_ws(rest)).alias("body"),
        F.regexp_extract(body, IMG_PATTERN, 1).alias("image"),
        F.regexp_extract(img, r"""(?i)alt=["']([^"']*)["']""", 1).alias("imageAlt"),
    )


def extract_section_images(sections: Column) -> Column:
    def one(s: Column) -> Column:
        return F.when(s["image"] != "", s).otherwise(
            once(
                extract_image(s["body"]),
                lambda e: F.struct(
                    e["body"].alias("body"), e["image"].alias("image"),
                    F.when(e["image"] == "", s["imageAlt"]).otherwise(e["imageAlt"]).alias("imageAlt"),
                    s["imagePosition"].alias("imagePosition"), s["showCTAs"].alias("showCTAs"),
                ),
            )
        )

    return F.transform(sections, one)
