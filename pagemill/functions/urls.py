"""URL and path helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import null_if_empty, slugify, strip_ws

# The query parameters that lead tracking captures.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "gbraid", "wbraid",
]


def url_path_of(url: Column) -> Column:
    """Path of an absolute URL, ``/`` when it has none, NULL when unparsable."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path == "", F.lit("/")).otherwise(path)


def strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^/+|(?<!/)/+\z", "")


def stored_slug(c: Column) -> Column:
    bare = strip_slashes(c)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("/")))


def cms_path(c: Column) -> Column:
    """URL or path to a path with exactly one trailing slash."""
    path = F.when(c.rlike("^https?://"), url_path_of(c)).otherwise(c)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("/"))
        .when(path == "/", F.lit("/"))
        .otherwise(F.concat(F.regexp_replace(path, r"(?<!/)/+\z", ""), F.lit("/")))
    )


def enforce_trailing_slash(c: Column) -> Column:
    """Collapse double slashes and end the path with a slash; query and fragment stay."""
    path = F.regexp_replace(F.regexp_extract(c, r"^[^?#]*", 0), "/{2,}", "/")
    rest = F.regexp_extract(c, r"[?#][\s\S]*\z", 0)
    closed = F.when((F.length(path) > 1) & ~F.endswith(path, F.lit("/")), F.concat(path, F.lit("/"))).otherwise(path)
    return F.concat(closed, rest)


def import_slug(raw: Column, title: Column) -> Column:
    """Slug of a source URL, path or bare slug; the title is the fallback."""
    c = strip_ws(raw)
    c = F.when(F.startswith(c, F.lit("http")), F.coalesce(url_path_of(c), c)).otherwise(c)
    nested = F.regexp_extract(c, r"/practice-areas/([^/?#]+)", 1)
    bare = strip_slashes(c)
    last = F.element_at(F.filter(F.split(bare, "/"), lambda p: p != ""), -1)
    picked = F.when(nested != "", nested).when(F.contains(bare, F.lit("/")), last).otherwise(bare)
    return F.coalesce(null_if_empty(picked), slugify(title))


def resolve_url(url: Column, origin: str) -> Column:
    """Absolute form of one link; special schemes and fragments stay."""
    u = strip_ws(url)
    return (
        F.when(u.rlike("(?i)^(?:https?://|data:|mailto:|tel:|#|javascript:)") | (u == ""), u)
        .when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u))
        .when(F.startswith(u, F.lit("/")), F.concat(F.lit(origin), u))
        .otherwise(F.concat(F.lit(origin + "/"), u))
    )


def link_href(c: Column) -> Column:
    """Editor-entered link to a site path or an absolute URL."""
    t = strip_ws(c)
    return (
        F.when(t == "", F.lit(""))
        .when(t.rlike("(?i)^https?://"), t)
        .when(F.startswith(t, F.lit("//")), F.concat(F.lit("https:"), t))
        .when(t.rlike(r"(?i)^(/|mailto:|tel:|#|\?)"), t)
        .when(t.rlike(rf"(?i)^(?:www\.)?[^/\s]+\.[^/\s]+(?:/.*)?\z"), F.concat(F.lit("https://"), t))
        .otherwise(F.concat(F.lit("/"), F.regexp_replace(t, r"^[./]+", "")))
    )


def is_http_url(c: Column) -> Column:
    host = F.try_parse_url(strip_ws(c), F.lit("HOST"))
    return F.coalesce(F.lower(strip_ws(c)).rlike("^https?://") & (F.length(host) > 0), F.lit(False))


def is_image_url(c: Column) -> Column:
    return F.startswith(c, F.lit("/")) | is_http_url(c)


def redirect_target(c: Column) -> Column:
    """Root-relative or http(s) target, else NULL."""
    t = strip_ws(c)
    absolute = F.when(F.coalesce(F.try_parse_url(t, F.lit("PATH")), F.lit("x")) == "", F.concat(t, F.lit("/"))).otherwise(t)
    return F.when(F.startswith(t, F.lit("/")), t).when(is_http_url(t), absolute)


def query_param(url: Column, name: str) -> Column:
    """Decoded, trimmed first value of a query parameter, blank when absent."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return strip_ws(F.coalesce(F.try_url_decode(raw), raw, F.lit("")))


def is_blog_post_path(c: Column) -> Column:
    return cms_path(c).rlike(r"^/blog/[^/]+/\z")


def is_practice_detail_path(c: Column) -> Column:
    return cms_path(c).rlike(r"^/practice-areas/[^/]+/\z")


def mime_from_url(c: Column) -> Column:
    # Image type by file extension.
    path = F.lower(F.regexp_replace(F.regexp_replace(strip_ws(c), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#][\s\S]*", ""))
    kinds = [
        (r"\.svg\z", "image/svg+xml"), (r"\.png\z", "image/png"), (r"\.jpe?g\z", "image/jpeg"),
        (r"\.webp\z", "image/webp"), (r"\.ico\z", "image/x-icon"),
    ]
    out = None
    for pattern, kind in kinds:
        out = F.when(path.rlike(pattern), kind) if out is None else out.when(path.rlike(pattern), kind)
    return out


def normalized_link(href: Column, base: str) -> Column:
    """Absolute link without fragment, for matching against a crawl table."""
    return F.regexp_replace(resolve_url(href, base), r"#[\s\S]*\z", "")
