"""Text helpers: Column in, Column out, no Python at run time."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The white-space characters of the source dialect, as a regex class body and as text.
WS_CHARS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS_TEXT = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_CHARS}]"
WIDE_SPACES = WS_TEXT[6:]
# The wide ones as a regex class; the range before it turns plain letters away at once.
WIDE = rf"[\x{{A0}}-\x{{FEFF}}&&[{WS_CHARS.partition(' ')[2]}]]"

SLUG_PATTERN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?\z"
HTML_HINT = r"(?i)<[a-z][^>]*>"
# White space that ``squeeze`` changes: a run, or one that is no plain space.
RUN = r"\s(?:\s+|(?<! ))"

# Shortcode names that carry layout only.
SHORTCODE_NAMES = [
    "fusion_builder_container", "fusion_builder_row", "fusion_builder_column",
    "av_section", "av_one_full", "av_one_half", "av_one_third", "av_two_third",
    "av_textblock", "av_toggle_container", "av_toggle", "fl_builder_insert_layout",
    "cs_section", "cs_row", "cs_column", "cs_text", "wpforms", "contact-form-7", "gravityform",
]
SHORTCODE_WORDS = [
    "row", "column", "section", "container", "wrapper", "spacer", "divider", "separator", "clear",
]
SHORTCODE_PREFIXES = ["et_pb_", "vc_"]
SHORTCODE_HINT = r"(?i)\[(et_pb_|vc_|fusion_|av_|cs_|fl_builder)"
SHORTCODE_REMNANT = r"(?i)\[(et_pb_|vc_|fusion_)"

# Named entities, in decoding order.
NAMED_ENTITIES = [
    ("&amp;", "&"), ("&nbsp;", " "), ("&rsquo;", "’"), ("&lsquo;", "‘"),
    ("&rdquo;", "”"), ("&ldquo;", "“"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&hellip;", "…"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"),
    ("&bull;", "•"), ("&middot;", "·"), ("&frac12;", "½"), ("&frac14;", "¼"),
    ("&frac34;", "¾"), ("&deg;", "°"), ("&times;", "×"), ("&divide;", "÷"),
]
# UTF-8 read as Latin-1, in repair order.
MOJIBAKE = [
    ("\u00c3\u00a9", "\u00e9"), ("\u00c3\u00a8", "\u00e8"), ("\u00c3\u00a0", "\u00e0"),
    ("\u00c3\u00bc", "\u00fc"), ("\u00c3\u00b6", "\u00f6"), ("\u00c3\u00a4", "\u00e4"),
    ("\u00c3\u00b1", "\u00f1"), ("\u00c2\u00a0", " "), ("\u00c2\u00ab", "\u00ab"),
    ("\u00c2\u00bb", "\u00bb"), ("\u00e2\u0080\u0099", "\u2019"), ("\u00e2\u0080\u009c", "\u201c"),
    ("\u00e2\u0080\u009d", "\u201d"), ("\u00e2\u0080\u0093", "\u2013"), ("\u00e2\u0080\u0094", "\u2014"),
]
# Each of the above begins with one of these.
MOJIBAKE_MARKS = ["\u00c3", "\u00c2", "\u00e2\u0080"]
ZERO_WIDTH = ["\u200b", "\u200c", "\u200d", "\ufeff"]
MOJIBAKE_HINT = (
    r"\x{00C3}[\x{0080}-\x{00BF}]|\x{00C2}[\x{00A0}-\x{00BF}]|\x{00E2}\x{0080}[\x{0090}-\x{009F}]"
)


def bound(fn):
    """Evaluate the first argument once, however often the function refers to it."""

    @functools.wraps(fn)
    def wrapper(c: Column, *args, **kwargs) -> Column:
        return once(c, lambda v: fn(v, *args, **kwargs))

    return wrapper


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a costly value to a name inside one expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_ws(c: Column) -> Column:
    """Trim every kind of white space, line breaks included."""
    return F.trim(c, F.lit(WS_TEXT))


@bound
def strip_long(c: Column) -> Column:
    """As ``strip_ws``, for long texts: trimming looks at every character, while visible ASCII at both ends tells that nothing goes."""
    raw = c.cast("binary")
    shown = [F.substring(raw, at, 1).between(F.lit(b"!"), F.lit(b"~")) for at in (1, -1)]
    return F.when(shown[0] & shown[1], c).otherwise(strip_ws(c))


def plain_spaces(c: Column) -> Column:
    """Every wide space to a plain one. Patterns with ``\\s`` then see all white space and stay
    several times faster than with the full class; ``translate`` would look up each character."""
    return F.regexp_replace(c, WIDE, " ")


def holds(c: Column, *marks: str) -> Column:
    """Whether a text holds one of some literals. A literal that every match of a pattern has tells far faster where there is none."""
    return functools.reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in marks])


def tag_like(c: Column, pattern: str, *starts: str) -> Column:
    """``c.rlike(pattern)`` for a pattern whose matches begin with one of ``starts``, which have one letter at most, small or capital.

    A literal is sought in the bytes as they stand; for a pattern they are decoded first.
    """
    both = dict.fromkeys(v for s in starts for v in (s, s.upper()))
    return holds(c, *both) & c.rlike(pattern)


def where_holds(c: Column, marks: list[str], step: Callable[[Column], Column]) -> Column:
    """``step`` on texts that hold one of ``marks``; without them it would change nothing."""
    return F.when(holds(c, *marks), step(c)).otherwise(c)


def up_to(close: str) -> str:
    """Regex: everything up to and with the first ``<`` that ``close`` follows. As ``.*?<close``, but text is run over in one loop."""
    return f"[^<]*(?:<(?!{close})[^<]*)*+<{close}"


def nonblank(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[^{WS_CHARS}]"), F.lit(False))


def null_if_blank(c: Column) -> Column:
    """NULL when the value is null or white space, else the value itself."""
    return F.when(nonblank(c), c)


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[null_if_empty(c) for c in cols])


def squeeze(c: Column) -> Column:
    """Every run of white space to one space, then trim."""
    return F.trim(F.regexp_replace(plain_spaces(c), RUN, " "))


def words(c: Column) -> Column:
    return F.filter(F.split(plain_spaces(c), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return squeezed_word_count(squeeze(c))


@bound
def squeezed_word_count(c: Column) -> Column:
    """Words of a text that ``squeeze`` gave: its spaces and one. Counting matches would build an array of all words."""
    return F.when(c == "", 0).otherwise(F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def strip_tags(c: Column, replacement: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]*>", replacement)


def plain_text(c: Column) -> Column:
    """Tags to spaces, white space squeezed."""
    return squeeze(strip_tags(c, " "))


def tag_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("<[^>]+>"))


def slugify(c: Column) -> Column:
    c = F.regexp_replace(plain_spaces(F.lower(c)), r"[^\w\s-]++", "")
    c = F.regexp_replace(c, r"[\s_]+", "-")
    c = F.regexp_replace(c, "-+", "-")
    return F.regexp_replace(c, r"^-|-\z", "")


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def excerpt(excerpt_col: Column, body_col: Column, limit: int = 110) -> Column:
    """Listing text: excerpt or body without tags, shortened with three dots."""
    text = plain_text(F.coalesce(null_if_empty(excerpt_col), body_col, F.lit("")))
    return F.when(
        F.length(text) > limit,
        F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")),
    ).otherwise(text)


def fingerprint(c: Column) -> Column:
    """Comparison text: tags, entities and punctuation out, lower case."""
    c = F.regexp_replace(c, "(?i)<[^>]*>|&[a-z]+;", " ")
    c = F.regexp_replace(plain_spaces(c), r"[^\w\s]++", "")
    return F.lower(F.trim(F.regexp_replace(c, RUN, " ")))


def replace_first(text: Column, needle: Column, replacement: Column) -> Column:
    """Change only the first occurrence of a literal."""
    at = F.instr(text, needle)
    return F.when(
        (at > 0) & (F.length(needle) > 0),
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            replacement,
            F.substring(text, at + F.length(needle), F.length(text)),
        ),
    ).otherwise(text)


def safe_start(c: Column, n: int) -> Column:
    """The first ``n`` characters less a tag or entity that is cut: what stays cleans to the start of what the whole text cleans to."""
    return F.regexp_replace(F.substring(c, 1, n), r"(?:<[^>]*|&[a-zA-Z]*)\z", "")


def strip_shortcodes(c: Column) -> Column:
    return once(once(c, lambda t: where_holds(t, ["["], _strip_brackets)), lambda t: where_holds(t, ['="', "='"], _strip_builder_data))


def _strip_brackets(c: Column) -> Column:
    prefixes = "|".join(SHORTCODE_PREFIXES)
    names = "|".join(SHORTCODE_NAMES)
    layout = "|".join(SHORTCODE_WORDS)
    return F.regexp_replace(
        c,
        rf"(?i)\[/?(?:{prefixes})[^\]]*\]|\[(?:{names})[^\]]*\]|\[/(?:{names})\]"
        rf"|\[/?(?:{layout})\b[^\]]*\]",
        "",
    )


def _strip_builder_data(c: Column) -> Column:
    gone = F.regexp_replace(
        c,
        r"""(?i)\s*data-elementor-[a-z-]*="[^"]*"|\s*data-(?:widget|element)_type="[^"]*"|\s*data-settings='[^']*'""",
        "",
    )
    return F.when(c.rlike("(?i)data-(?:elementor|widget|element|settings)"), gone).otherwise(c)


def _code_unit(n: Column) -> Column:
    """The character of a code unit below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")


def decode_numeric_entities(c: Column) -> Column:
    """``&#65;`` and ``&#x41;`` to characters, for 1..65535; others stay."""

    def pass_over(text: Column, shape: str, to_number) -> Column:
        pieces = F.split(text, r"(?=&#)|(?<=;)")

        def decode(p: Column) -> Column:
            n = to_number(F.regexp_extract(p, shape, 1))
            return F.when(p.rlike(shape) & (n > 0) & (n < 65536), _code_unit(n)).otherwise(p)

        return F.array_join(F.transform(pieces, decode), "")

    c = pass_over(c, r"^&#(\d+);\z", lambda d: d.try_cast("bigint"))
    return pass_over(
        c, r"(?i)^&#x([0-9a-f]+);\z",
        lambda d: F.when(F.length(F.regexp_replace(d, "^0+", "")) <= 8, F.conv(d, 16, 10)).try_cast("bigint"),
    )


def _replaced(pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
    return lambda c: functools.reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


@bound
def fix_encoding(c: Column) -> Column:
    entities = once(
        where_holds(c, ["&#"], decode_numeric_entities), lambda t: F.when(t.rlike("&[a-z]+[0-9]*;"), _replaced(NAMED_ENTITIES)(t)).otherwise(t))
    return once(F.when(holds(c, "&"), entities).otherwise(c), lambda t: where_holds(t, MOJIBAKE_MARKS, _replaced(MOJIBAKE)))


@bound
def normalize_whitespace(c: Column) -> Column:
    c = where_holds(c, ZERO_WIDTH, lambda t: F.regexp_replace(t, r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""))
    c = once(c, lambda t: F.when(F.length(t) < F.octet_length(t), plain_spaces(t)).otherwise(t))
    return squeeze_newlines(once(c, lambda t: where_holds(
        t, ["  ", "\t", "\x0b", "\f", "\r"], lambda t: F.regexp_replace(t, r"[ \t\x0B\f\r](?:[ \t\x0B\f\r]+|(?<! ))", " "))))


@bound
def squeeze_newlines(c: Column) -> Column:
    return strip_long(where_holds(c, ["\n\n\n"], lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def _paragraphs(c: Column) -> Column:
    parts = F.transform(F.split(c, rf"\n{WS}*\n"), strip_ws)
    return F.filter(parts, lambda p: p != "")


def _wrap(parts: Column) -> Column:
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))),
        "",
    )


@bound
def ensure_html(c: Column) -> Column:
    """Plain text to paragraphs; text that already holds a tag passes."""
    return (
        F.when(~nonblank(c), F.lit(""))
        .when(F.substring(c, 1, 200).rlike(HTML_HINT) | c.rlike(HTML_HINT), c)
        .otherwise(_wrap(_paragraphs(c)))
    )


@bound
def html_transform(c: Column) -> Column:
    return F.when(c.rlike(HTML_HINT), c).otherwise(_wrap(_paragraphs(c)))


def markdown_to_html(c: Column) -> Column:
    """Headings, bold, italic, links, lists and paragraphs."""
    steps = [
        (r"(?m)^### (.+)$", "<h3>$1</h3>"),
        (r"(?m)^## (.+)$", "<h2>$1</h2>"),
        (r"(?m)^# (.+)$", "<h1>$1</h1>"),
        (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
        (r"__(.+?)__", "<strong>$1</strong>"),
        (r"\*(.+?)\*", "<em>$1</em>"),
        (r"_(.+?)_", "<em>$1</em>"),
        (r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>'),
        (r"(?m)^[*-] (.+)$", "<li>$1</li>"),
        (r"(?s)(<li>.*?</li>)", "<ul>$1</ul>"),
        (rf"</ul>{WS}*<ul>", ""),
        (r"(?m)^\d+\. (.+)$", "<li>$1</li>"),
    ]
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    lines = F.filter(F.transform(F.split(c, "\n"), strip_ws), lambda x: x != "")
    return F.array_join(
        F.transform(
            lines,
            lambda x: F.when(x.rlike("^<(h[1-6]|ul|ol|li|p|div|blockquote)"), x).otherwise(
                F.concat(F.lit("<p>"), x, F.lit("</p>"))
            ),
        ),
        "",
    )


def escape_xml(c: Column) -> Column:
    # The five XML escapes, ampersand first.
    for raw, escaped in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """Replace every ``{{name}}`` by its field, blank when null."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets, 0 when either is empty."""
    sets = F.struct(F.array_distinct(words(F.lower(a))).alias("a"), F.array_distinct(words(F.lower(b))).alias("b"))

    def ratio(s: Column) -> Column:
        total = F.size(s["a"]) + F.size(s["b"])
        share = once(F.size(F.array_intersect(s["a"], s["b"])), lambda n: n / (total - n))
        return F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(share)

    return once(sets, ratio)


def round2(c: Column) -> Column:
    """Half-up to two places by arithmetic, as the score rules define it."""
    return F.floor(c * 100 + 0.5).cast("double") / 100


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def positive_or_null(c: Column) -> Column:
    return F.when((c > 0) & ~F.isnan(c.cast("double")) & (c.cast("double") != float("inf")), c)


def append_site_name(title: Column, site_name: Column) -> Column:
    site = F.lower(strip_ws(site_name))
    t = F.lower(strip_ws(title))
    return (
        F.when(null_if_empty(title).isNull(), site_name)
        .when(null_if_empty(site).isNull(), title)
        .when((t == site) | F.endswith(t, F.concat(F.lit("| "), site)) | F.endswith(t, F.concat(F.lit("- "), site)), title)
        .otherwise(F.concat(title, F.lit(" | "), site_name))
    )


def has_placeholder(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("lorem ipsum"))


def schema_types(c: Column) -> Column:
    """Type list from NULL, one name, a comma list or a JSON array."""
    listed = F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>"))
    raw = F.coalesce(listed, F.split(c, ","), F.array().cast("array<string>"))
    return F.filter(F.transform(raw, strip_ws), lambda t: t != "")


def address_city(line: Column) -> Column:
    return F.coalesce(strip_ws(F.get(F.split(line, ","), F.lit(0))), F.lit(""))


def address_region(line: Column) -> Column:
    second = strip_ws(F.get(F.split(line, ","), F.lit(1)))
    return F.coalesce(strip_ws(F.regexp_replace(second, r"\d+", "")), F.lit(""))


def address_zip(line: Column) -> Column:
    return F.coalesce(F.regexp_extract(line, r"\d{5}(-\d{4})?", 0), F.lit(""))
