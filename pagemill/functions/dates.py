"""Publish dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.text import strip_ws

# Accepted free-text layouts, tried in this order (zone UTC).
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm:ss z",
]


def publish_date(c: Column) -> Column:
    """Timestamp from epoch text (13 digits are ms, 10 to 12 seconds) or free text, else NULL."""
    t = strip_ws(c.cast("string"))
    number = t.try_cast("bigint")
    named = F.regexp_replace(t, r"^[A-Za-z]{3}, ", "")
    parsed = F.coalesce(*[F.try_to_timestamp(named, F.lit(f)) for f in DATE_FORMATS])
    return (
        F.when(t.rlike(r"^\d{13}\z"), F.timestamp_millis(number))
        .when(t.rlike(r"^\d{10,12}\z"), F.timestamp_seconds(number))
        .when(t != "", parsed)
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def publish_date_or(c: Column, fallback: Column) -> Column:
    """``struct(published_at, publish_date_source)``; provenance is mapped or fallback."""
    found = publish_date(c)
    return F.struct(
        F.coalesce(found, fallback).alias("published_at"),
        F.when(found.isNotNull(), "mapped").otherwise("fallback").alias("publish_date_source"),
    )


def display_date(published: Column, created: Column, long: bool = True) -> Column:
    return F.date_format(F.coalesce(published, created), "MMMM d, yyyy" if long else "MMM d, yyyy")
