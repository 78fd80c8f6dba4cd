"""Fragments of the reference SQL (for a RE2 regex dialect)."""

from __future__ import annotations

from pagemill.functions.text import WS_CHARS

WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def strip_tags(x: str, to: str = "") -> str:
    return f"regexp_replace({x}, '<[^>]*>', '{to}', 'g')"


def plain(x: str) -> str:
    return squeeze(strip_tags(x, " "))


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NOT_WS}+'))"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_WS}+')"


def slug(x: str) -> str:
    x = f"regexp_replace(lower({x}), '[^A-Za-z0-9_{WS_CHARS}-]', '', 'g')"
    x = f"regexp_replace({x}, '[{WS_CHARS}_]+', '-', 'g')"
    return f"regexp_replace(regexp_replace({x}, '-+', '-', 'g'), '^-|-$', '', 'g')"


def fingerprint(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?i)&[a-z]+;', ' ', 'g')"
    x = f"regexp_replace({x}, '[^A-Za-z0-9_{WS_CHARS}]', '', 'g')"
    return f"lower({squeeze(x)})"


def shell(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<!DOCTYPE[^>]*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<head\b[^>]*>.*?</head>', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)^.*?<body\b[^>]*>(.*)</body>.*$', '\1')"
    x = rf"regexp_replace({x}, '(?i)</?(?:html|body)\b[^>]*>', '', 'g')"
    for tag in ("script", "style", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:link|meta)\b[^>]*/?>', '', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"


def ensure_html(x: str) -> str:
    paras = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n{WS}*\\n'), lambda p: {trim('p')}), lambda p: p <> '')"
    wrapped = f"array_to_string(list_transform({paras}, lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '')"
    return (
        f"case when not regexp_matches({x}, '{NOT_WS}') then '' "
        f"when regexp_matches({x}, '(?is)<[a-z].*>') then {x} else {wrapped} end"
    )


def truncate(x: str, n: int) -> str:
    return f"case when length({x}) > {n} then substr({x}, 1, {n}) || '…' else {x} end"


def round2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def path_of(x: str) -> str:
    return (
        f"case when regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' "
        f"else regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) end"
    )


def cms_path(path: str) -> str:
    return f"case when ({path}) = '/' then '/' else regexp_replace({path}, '/+$', '') || '/' end"


SLUG_OK = "^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
