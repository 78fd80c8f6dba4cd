"""Phone number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import strip_ws

# Phone-like text, as the audit and as the number sync read it.
AUDIT_PHONE = r"(?<![/\d])\+?\d[\d\s().-]{7,}\d"
SYNC_PHONE = r"(?:\+?1[\s.-]*)?(?:\(\d{3}\)|\d{3})[\s.-]*\d{3}[\s.-]*\d{4}\b"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d]", "")


def sync_digits(c: Column) -> Column:
    """Digits without the leading 1 of an eleven-digit number."""
    d = digits_only(c)
    return F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10)).otherwise(d)


def audit_phones(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(AUDIT_PHONE), F.lit(0)), strip_ws)


def sync_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(SYNC_PHONE), F.lit(0)), sync_digits)
    return F.filter(found, lambda d: F.length(d) >= 10)


def _parts(d: Column):
    return F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)


def primary_format(d: Column) -> Column:
    a, b, c = _parts(d)
    return F.when(F.length(d) == 10, F.concat_ws("-", a, b, c)).otherwise(d)


def format_variants(d: Column) -> Column:
    a, b, c = _parts(d)
    return F.when(
        F.length(d) == 10,
        F.array(
            F.concat_ws("-", a, b, c),
            F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c),
            F.concat_ws(".", a, b, c),
            F.concat_ws(" ", a, b, c),
            d,
        ),
    ).otherwise(F.array(d))
