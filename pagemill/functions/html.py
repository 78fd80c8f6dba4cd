"""Markup helpers that work inside one value: Column in, Column out.

Nothing here shuffles. Steps that need element nesting are in
``pagemill.operators.tokens``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import (
    WS, bound, fingerprint, nonblank, once, safe_start, squeeze_newlines, strip_long, strip_tags, strip_ws, tag_like, up_to, where_holds,
)
from pagemill.functions.urls import resolve_url

# Tag groups.
WRAPPER_TAGS = ["div", "section", "article", "aside", "header", "footer", "main", "nav", "span"]
CLEAN_EMPTY_TAGS = ["p", "div", "span", "section", "article", "aside", "header", "footer", "main"]
SEMANTIC_TAGS = ["p", "h[1-6]", "ul", "ol", "dl", "blockquote", "table", "img"]
CONTENT_TAGS = [
    "p", "h[1-6]", "ul", "ol", "li", "dl", "dd", "dt", "blockquote", "table", "tr", "td", "th",
    "figure", "figcaption", "a", "img", "strong", "em",
]
# A block runs to the first closing tag of any block name.
_BLOCK_CLOSE = "/(?:p|div|section|article|aside|blockquote|ul|ol|dl|table|figure|h[1-6]|pre|form|nav|header|footer)>"
BLOCK_PATTERN = (
    r"(?is)<(?:p|div|section|article|aside|blockquote|ul|ol|dl|table|figure|h[1-6]|pre|hr|form|nav|header|footer)\b[^>]*>"
    rf"{up_to(_BLOCK_CLOSE)}|<hr\s*/?>"
)
IMG_PATTERN = r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*>"""
SHORT_FINGERPRINT = 20
# Characters of a block and of its fingerprint that mostly tell it from others.
START_CHARS, START_PRINT = 400, 40


def repeat_until_stable(c: Column, step) -> Column:
    """Apply a text step until it changes nothing more.

    The steps take elements out, so there are no more changing passes than closing tags, and one that renames. A pass
    that changes nothing is the last to look at the text: elements nested n deep take n passes and one more.
    """

    def advance(state: Column, _: Column) -> Column:
        done = once(step(state["text"]), lambda new: F.struct(new.alias("text"), new.eqNullSafe(state["text"]).alias("done")))
        return F.when(state["done"], state).otherwise(done)

    def settle(text: Column) -> Column:
        start = F.struct(text.alias("text"), text.isNull().alias("done"))
        closing = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("</"), F.lit("")))) / 2
        passes = F.sequence(F.lit(1), closing.cast("int") + 2)
        return where_holds(text, ["<"], lambda _: F.aggregate(passes, start, advance, lambda s: s["text"]))

    return once(c, settle)


@bound
def strip_page_shell(c: Column) -> Column:
    """Doctype, head, scripts, styles, comments and the html/body tags out."""
    return where_holds(c, ["<"], _strip_page_shell)


def _strip_page_shell(c: Column) -> Column:
    c = once(c, lambda t: where_holds(t, ["<!"], lambda t: F.regexp_replace(t, r"(?i)<!DOCTYPE[^>]*>", "")))
    c = once(c, lambda t: where_holds(t, ["<he", "<hE", "<He", "<HE"], lambda t: F.regexp_replace(t, r"(?is)<head\b[^>]*>.*?</head>", "")))
    c = F.regexp_replace(c, r"(?is)^.*?<body\b[^>]*>(.*)</body>.*\z", "$1")
    c = F.regexp_replace(c, r"(?i)</?(?:html|body)\b[^>]*>", "")
    return once(c, lambda t: F.when(tag_like(t, "(?i)<(?:script|style|noscript|link|meta|!--)", "<s", "<n", "<l", "<m", "<!"), _strip_unseen(t)).otherwise(t))


def _strip_unseen(c: Column) -> Column:
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(c, r"(?i)<(?:link|meta)\b[^>]*/?>", "")
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def _drop_empty(tags: list[str], filler: str):
    pattern = rf"(?i)<({'|'.join(tags)})\b[^>]*>(?:{filler})*+</\1>"
    return lambda c: F.regexp_replace(c, pattern, "")


def clean_empty_html(c: Column) -> Column:
    return repeat_until_stable(c, _drop_empty(CLEAN_EMPTY_TAGS, f"{WS}++|&nbsp;"))


def remove_empty_wrappers(c: Column) -> Column:
    return repeat_until_stable(c, _drop_empty(WRAPPER_TAGS, f"{WS}++|&nbsp;"))


def remove_empty_elements(c: Column) -> Column:
    filler = rf"{WS}++|&nbsp;|<br\s*/?>"
    return repeat_until_stable(c, _drop_empty(WRAPPER_TAGS + ["p"], filler))


@bound
def strip_layout_attributes(c: Column) -> Column:
    """Class, id, style, data, role and aria attributes off layout tags; builder classes off content tags."""
    return where_holds(c, ["<"], _strip_layout_attributes)


def _strip_layout_attributes(c: Column) -> Column:
    layout = rf"(?i)^<({'|'.join(WRAPPER_TAGS)})(\s[^>]*)>"
    noise = (
        r"""(?i)\s*(?:class|id|style|role|data-[a-z-]*|aria-[a-z-]*)\s*=\s*(?:"[^"]*"|'[^']*')"""
    )

    def clean(piece: Column) -> Column:
        tag = F.regexp_extract(piece, layout, 1)
        attrs = strip_ws(F.regexp_replace(F.regexp_extract(piece, layout, 2), noise, ""))
        rest = F.regexp_replace(piece, r"^<[^>]*>", "")
        head = F.when(attrs == "", F.concat(F.lit("<"), tag, F.lit(">"))).otherwise(
            F.concat(F.lit("<"), tag, F.lit(" "), attrs, F.lit(">"))
        )
        return F.when(tag != "", F.concat(head, rest)).otherwise(piece)

    pieces = F.array_join(F.transform(F.split(c, "(?=<)"), clean), "")
    c = F.when(c.rlike(rf"(?i)<(?:{'|'.join(WRAPPER_TAGS)})\s"), pieces).otherwise(c)
    return once(c, lambda t: where_holds(t, ['="'], _strip_builder_classes))


def _strip_builder_classes(c: Column) -> Column:
    return F.regexp_replace(
        c,
        rf"""(?i)<({'|'.join(CONTENT_TAGS)})\b([^>]*)\s+class="[^"]*(?:elementor|et_pb_|vc_|fl-|fusion-|av-|cs-)[^"]*"([^>]*)>""",
        "<$1$2$3>",
    )


def absolute_urls(c: Column, origin: str) -> Column:
    """Absolute href, src and srcset values against one origin."""
    attr = r"""((?:href|src)\s*=\s*["'])"""
    c = F.regexp_replace(c, rf"""(?i){attr}\s*+([^"']*?)\s*(["'])""", "$1$2$3")
    c = F.regexp_replace(c, rf"(?i){attr}/(?!/)", "$1" + origin.replace("$", r"\$") + "/")
    c = F.regexp_replace(c, rf"(?i){attr}//", "$1https://")
    c = F.regexp_replace(
        c,
        rf"""(?i){attr}(?!https?://|data:|mailto:|tel:|#|javascript:|["'])""",
        "$1" + origin.replace("$", r"\$") + "/",
    )
    srcset = r"""(?i)^(srcset\s*=\s*["'])([^"']*)([\s\S]*)\z"""

    def entry(e: Column) -> Column:
        parts = F.split(strip_ws(e), f"{WS}+")
        return F.array_join(
            F.concat(F.array(resolve_url(F.get(parts, F.lit(0)), origin)), F.slice(parts, F.lit(2), F.size(parts))),
            " ",
        )

    def rewrite(piece: Column) -> Column:
        values = F.split(F.regexp_extract(piece, srcset, 2), ",")
        return F.when(
            piece.rlike(srcset),
            F.concat(
                F.regexp_extract(piece, srcset, 1),
                F.array_join(F.transform(values, entry), ", "),
                F.regexp_extract(piece, srcset, 3),
            ),
        ).otherwise(piece)

    return F.array_join(F.transform(F.split(c, r"""(?i)(?=srcset\s*=\s*["'])"""), rewrite), "")


def origin_of(domain: str) -> str:
    """Scheme and host of a configured site domain."""
    from urllib.parse import urlsplit

    base = domain.strip().rstrip("/")
    if not base.lower().startswith(("http://", "https://")):
        base = "https://" + base
    parts = urlsplit(base)
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}"


def clean_inline_markup(c: Column) -> Column:
    """Unwrap plain spans, flatten doubled emphasis, b to strong, i to em, drop empty inline tags."""
    bare = r"(?:\s+(?:class|id|style|data-[a-z-]+)\s*=[^>]*|\s*)"

    def unwrapped(t: Column) -> Column:
        # A span with another first attribute is kept whole (group 1); others keep their inside (group 2).
        t = F.regexp_replace(
            t, rf"(?is)(<span(?!{bare}>)\s[^>]*>.*?</span>)|<span{bare}>(.*?)</span>", "$1$2"
        )
        for tag in ("strong", "b", "em", "i"):
            t = F.regexp_replace(
                t,
                rf"(?is)<{tag}(?:\s[^>]*)?>\s*<{tag}(?:\s[^>]*)?>(.*?)</{tag}>\s*</{tag}>",
                f"<{tag}>$1</{tag}>",
            )
        for old, new in (("b", "strong"), ("i", "em")):
            t = F.regexp_replace(t, rf"(?i)<{old}(?:\s[^>]*)?>", f"<{new}>")
            t = F.regexp_replace(t, rf"(?i)</{old}>", f"</{new}>")
        return F.regexp_replace(t, rf"(?i)<(strong|em|span|b|i)(?:\s[^>]*)?>({WS}*+)</\1>", "$2")

    return once(c, lambda t: F.when(t.rlike(r"(?i)</?(?:span|strong|b|em|i)[\s>]"), repeat_until_stable(t, unwrapped)).otherwise(t))


def _later_h1_to_h2(c: Column) -> Column:
    """Every matched h1 after the first becomes an h2."""

    def convert(part: Column, at: Column) -> Column:
        return F.when(
            at & part.rlike(r"(?is)^<h1(?:\s[^>]*)?>.*?</h1>"),
            F.regexp_replace(part, r"(?is)^<h1(\s[^>]*)?>(.*?)</h1>", "<h2$1>$2</h2>"),
        ).otherwise(part)

    # The split leaves no empty first piece, so only piece 0 or 1 can be the first h1.
    pieces = F.split(c, r"(?i)(?=<h1[\s>])")
    return once(
        pieces,
        lambda ps: once(
            F.when(F.get(ps, F.lit(0)).rlike(r"(?i)^<h1[\s>]"), 0).otherwise(1),
            lambda first: F.array_join(F.transform(ps, lambda p, i: convert(p, i > first)), ""),
        ),
    )


def heading_level_map(levels: Column) -> Column:
    """Fold heading levels, in page order, into a seven-slot level map without gaps."""
    slots = F.array(*[F.lit(0)] * 7)
    start = F.struct(slots.alias("to"), F.lit(0).alias("prev"))

    def put(arr: Column, level: Column, value: Column) -> Column:
        return F.transform(arr, lambda v, i: F.when(i == level, value).otherwise(v))

    def step(state: Column, level: Column) -> Column:
        before = F.get(state["to"], state["prev"])
        known = F.get(state["to"], level) > 0
        gap = (state["prev"] > 0) & (level > before + 1)
        new_to = (
            F.when(gap, put(state["to"], level, F.least(before + 1, F.lit(6))))
            .when(known, state["to"])
            .otherwise(put(state["to"], level, level))
        )
        return F.struct(new_to.alias("to"), level.alias("prev"))

    return F.aggregate(levels, start, step, lambda s: s["to"])


def _heading_levels(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?is)<h([1-6])(?:\s[^>]*)?>.*?</h\1>"), F.lit(1))
    return F.transform(found, lambda x: x.cast("int"))


def normalize_headings(c: Column) -> Column:
    """One h1 per page and no skipped heading level."""
    return once(c, lambda t: where_holds(t, ["<"], _normalize_headings))


def _normalize_headings(c: Column) -> Column:
    c = F.when(tag_like(c, r"(?i)<h1[\s>]", "<h1"), _later_h1_to_h2(c)).otherwise(c)

    def relevel(packed: Column) -> Column:
        def retag(piece: Column) -> Column:
            level = F.regexp_extract(piece, r"(?i)^</?h([1-6])", 1).cast("int")
            mapped = F.get(packed["to"], level)
            return F.when(
                piece.rlike(r"(?i)^</?h[1-6][\s>]") & (mapped > 0) & (mapped != level),
                F.concat(
                    F.regexp_extract(piece, r"(?i)^(</?h)[1-6]", 1),
                    mapped.cast("string"),
                    F.substring(piece, F.length(F.regexp_extract(piece, r"(?i)^(</?h[1-6])", 1)) + 1, F.length(piece)),
                ),
            ).otherwise(piece)

        pieces = F.transform(F.split(packed["text"], r"(?i)(?=</?h[1-6][\s>])"), retag)
        moved = F.exists(packed["levels"], lambda level: F.get(packed["to"], level) != level)
        return F.when((F.size(packed["levels"]) > 1) & moved, F.array_join(pieces, "")).otherwise(packed["text"])

    return once(
        once(
            once(c, lambda t: F.struct(t.alias("text"), _heading_levels(t).alias("levels"))),
            lambda s: F.struct(s["text"].alias("text"), s["levels"].alias("levels"), heading_level_map(s["levels"]).alias("to")),
        ),
        relevel,
    )


@bound
def remove_duplicate_blocks(c: Column) -> Column:
    """Keep the first block of each fingerprint inside one page; short ones are exempt."""

    def kept(s: Column) -> Column:
        return F.filter(
            s["b"],
            lambda _x, i: (F.length(F.get(s["f"], i)) < SHORT_FINGERPRINT)
            | (F.array_position(s["f"], F.get(s["f"], i)) == i + 1),
        )

    def rebuild(s: Column) -> Column:
        trailing = F.element_at(F.split(c, BLOCK_PATTERN), -1)
        return F.concat(F.array_join(kept(s), "\n"), once(trailing, lambda t: F.when(nonblank(t), t).otherwise("")))

    def long_ones(prints: Column) -> Column:
        return F.filter(prints, lambda f: F.length(f) >= SHORT_FINGERPRINT)

    def decide(s: Column) -> Column:
        return once(long_ones(s["f"]), lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), c).otherwise(rebuild(s)))

    def by_start(blocks: Column) -> Column:
        # Blocks whose fingerprints begin differently are no duplicates. A start without enough text (null) tells nothing.
        whole = once(F.struct(blocks.alias("b"), F.transform(blocks, fingerprint).alias("f")), decide)
        return once(
            F.transform(blocks, _print_start),
            lambda starts: F.when(
                F.forall(starts, lambda p: p.isNotNull()) & (F.size(F.array_distinct(long_ones(starts))) == F.size(long_ones(starts))), c
            ).otherwise(whole),
        )

    return where_holds(c, ["<"], lambda _: once(F.regexp_extract_all(c, F.lit(BLOCK_PATTERN), F.lit(0)), by_start))


def _print_start(block: Column) -> Column:
    """How the fingerprint of a block begins, from its first characters; null where these do not tell."""
    short = F.length(block) <= START_CHARS
    seen = fingerprint(F.when(short, block).otherwise(safe_start(block, START_CHARS)))
    return once(
        F.struct(short.alias("all"), seen.alias("f")),
        lambda s: F.when(s["all"] | (F.length(s["f"]) >= START_PRINT), F.substring(s["f"], 1, START_PRINT)),
    )


def strip_h1(c: Column) -> Column:
    return once(F.coalesce(c, F.lit("")), lambda t: strip_long(where_holds(t, ["<h1", "<H1"], lambda t: F.regexp_replace(t, r"(?is)<h1[^>]*>.*?</h1>", ""))))


@bound
def first_paragraph(c: Column) -> Column:
    p = F.regexp_extract(c, r"(?is)<p[^>]*>(.*?)</p>", 1)
    plain = strip_ws(strip_tags(c))
    return (
        F.when(c.rlike(r"(?is)<p[^>]*>.*?</p>"), F.concat(F.lit("<p>"), p, F.lit("</p>")))
        .when(F.length(plain) > 200, F.concat(F.lit("<p>"), F.substring(plain, 1, 200), F.lit("…</p>")))
        .when(plain != "", F.concat(F.lit("<p>"), plain, F.lit("</p>")))
        .otherwise("")
    )


def first_image(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))


@bound
def outline(c: Column) -> Column:
    """Headings h1 to h3 of a body, in order, as ``array<struct<level, text>>``."""
    levels = F.regexp_extract_all(c, F.lit(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"), F.lit(1))
    texts = F.regexp_extract_all(c, F.lit(r"(?is)<h([1-3])[^>]*>(.*?)</h\1>"), F.lit(2))
    return F.zip_with(
        levels, texts,
        lambda l, t: F.struct(l.cast("int").alias("level"), strip_ws(strip_tags(t)).alias("text")),
    )


def image_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMG_PATTERN), F.lit(1))


def form_segments(c: Column) -> Column:
    """Text cut at ``{{form:id}}`` marks, as ``array<struct<kind, value>>``."""
    pieces = F.filter(F.split(c, r"(?=\{\{form:)|(?<=\}\})"), lambda p: p != "")
    mark = r"^\{\{form:([^}]+)\}\}\z"
    return F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(mark),
            F.struct(F.lit("form").alias("kind"), strip_ws(F.regexp_extract(p, mark, 1)).alias("value")),
        ).otherwise(F.struct(F.lit("html").alias("kind"), p.alias("value"))),
    )


__all__ = [
    "strip_page_shell", "clean_empty_html", "remove_empty_wrappers", "remove_empty_elements",
    "strip_layout_attributes", "absolute_urls", "origin_of", "clean_inline_markup",
    "normalize_headings", "heading_level_map", "remove_duplicate_blocks", "strip_h1",
    "first_paragraph", "first_image", "outline", "image_list", "form_segments", "squeeze_newlines",
]
