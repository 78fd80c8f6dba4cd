"""Validation of mapped, prepared and scored records: an issue table.

Every check is a Column that is NULL when it passes; one ``explode`` turns the failures of a
row into issue rows ``row_index, field, message, severity``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import text as X
from pagemill.functions.dates import publish_date
from pagemill.functions.urls import is_http_url, strip_slashes
from pagemill.operators.templates import image_fields, required_fields

BAD_SLUG = "must be lowercase, alphanumeric with hyphens only"


def issue(cond: Column, field: str, message: Column | str, severity: str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.lit(field).alias("field"), text.alias("message"), F.lit(severity).alias("severity")),
    )


def issues(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda i: i.isNotNull())


def _blank(c: Column) -> Column:
    return ~X.nonblank(c)


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _quoted(prefix: str, c: Column, limit: int, suffix: str) -> Column:
    return F.concat(F.lit(prefix), X.truncate(c, limit), F.lit(suffix))


def issue_table(df: DataFrame, row_index: str, found: Column) -> DataFrame:
    return df.select(F.col(row_index).alias("row_index"), F.explode(found).alias("i")).select("row_index", "i.field", "i.message", "i.severity")


def mapped_checks(field: Callable[[str], Column], template: str, columns: list[str]) -> Column:
    """Checks on a mapped row; ``field`` gives a target field as text, NULL when unmapped."""
    checks = [
        issue(_blank(field(f.key)), f.key, f'"{f.label}" is required', "error") for f in required_fields(template)
    ]
    date = field("published_at")
    checks.append(
        issue(X.nonblank(date) & publish_date(date).isNull(), "published_at", _quoted('Publish date "', date, 50, '" could not be parsed'), "error")
    )
    key = "url_slug" if template == "practice" else "slug"
    slug = field(key)
    checks.append(issue(~_missing(slug) & ~slug.rlike(X.SLUG_PATTERN), key, _quoted('Slug "', slug, 40, f'" {BAD_SLUG}'), "error"))
    if template == "practice":
        has_sections = ~_missing(field("contentSections")) | ~_missing(field("contentSections.body"))
        indexed = any(c.startswith("body_") for c in columns)
        checks += [
            issue(_missing(field("hero.tagline")), "hero.tagline", "No hero tagline provided — default will be used", "warning"),
            issue(~has_sections & F.lit(not indexed), "contentSections", "No content sections — page will use defaults", "warning"),
        ]
    else:
        checks += [
            issue(_missing(field("body")), "body", "No body content — post will be empty", "warning"),
            issue(_missing(field("excerpt")), "excerpt", "No excerpt — it won't appear in blog listings", "warning"),
        ]
    for f in image_fields(template):
        url = field(f.key)
        checks.append(issue(~_missing(url) & ~is_http_url(url), f.key, _quoted(f'"{f.label}" has an invalid URL: "', url, 60, '"'), "error"))
    return issues(*checks)


def validate_mapped(df: DataFrame, row_index: str, template: str) -> DataFrame:
    """Issues of mapped rows, whose columns carry the target field names."""

    def field(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")

    return issue_table(df, row_index, mapped_checks(field, template, df.columns))


def _slug_checks(record: Column, template: str) -> list[Column]:
    if template == "practice":
        path = record["url_path"]
        slug = strip_slashes(path)
        none = _missing(path) | (path == "//")
        return [
            issue(none, "url_path", "URL path is required", "error"),
            issue(~none & (slug != "") & ~slug.rlike(X.SLUG_PATTERN), "url_path", "__shape__", "error"),
        ]
    slug = record["slug"]
    return [
        issue(_blank(slug), "slug", "Slug is required", "error"),
        issue(~_blank(slug) & ~slug.rlike(X.SLUG_PATTERN), "slug", "__shape__", "error"),
    ]


def _reworded(checks: list[Column], message: Column) -> list[Column]:
    return [F.when(c["message"] == "__shape__", c.withField("message", message)).otherwise(c) for c in checks]


def quick_checks(record: Column, template: str) -> Column:
    """Short per-record check used while preparing."""
    bad_title = _blank(record["title"]) | (record["title"] == "Untitled")
    checks = [issue(bad_title, "title", "Title is required", "error")]
    checks += _reworded(_slug_checks(record, template), F.lit(f"Slug {BAD_SLUG}"))
    if template == "practice":
        content = record["content"]
        checks += [
            issue(_missing(content["hero"]["tagline"]), "hero.tagline", "No hero tagline provided", "warning"),
            issue(F.coalesce(F.size(content["contentSections"]), F.lit(0)) <= 0, "contentSections", "No content sections — page will be empty", "warning"),
        ]
    else:
        checks += [
            issue(_missing(record["body"]), "body", "No body content — post will be empty", "warning"),
            issue(_missing(record["excerpt"]), "excerpt", "No excerpt — it won't appear in blog listings", "warning"),
        ]
    checks.append(issue(record["published_at"].isNull(), "published_at", "No publish date detected — import time will be used", "warning"))
    return issues(*checks)


def prepared_checks(record: Column, status: Column, template: str) -> Column:
    bad_title = _blank(record["title"]) | (record["title"] == "Untitled")
    checks = [
        issue(status == "needs-review", "status", "Record has not been approved yet", "warning"),
        issue(bad_title, "title", "Title is required", "error"),
    ]
    if template == "practice":
        slug = strip_slashes(record["url_path"])
        checks += _reworded(_slug_checks(record, template), _quoted('Slug "', slug, 40, f'" {BAD_SLUG}'))
        content = record["content"]
        image = content["hero"]["backgroundImage"]
        checks += [
            issue(_missing(content["hero"]["tagline"]), "hero.tagline", "No hero tagline provided", "warning"),
            issue(F.coalesce(F.size(content["contentSections"]), F.lit(0)) <= 0, "contentSections", "No content sections — page will be empty", "warning"),
            issue(~_missing(image) & ~is_http_url(image), "hero.backgroundImage", _quoted('Invalid hero image URL: "', image, 50, '"'), "warning"),
        ]
    else:
        checks += _reworded(_slug_checks(record, template), _quoted('Slug "', record["slug"], 40, f'" {BAD_SLUG}'))
        image = record["featured_image"]
        checks += [
            issue(_missing(record["body"]), "body", "No body content — post will be empty", "warning"),
            issue(_missing(record["excerpt"]), "excerpt", "No excerpt — it won't appear in blog listings", "warning"),
            issue(~_missing(image) & ~is_http_url(image), "featured_image", _quoted('Invalid featured image URL: "', image, 50, '"'), "warning"),
        ]
    return issues(*checks)


def duplicate_groups(df: DataFrame, row_index: str, key: str) -> DataFrame:
    """Members of every key held by more than one row: ``key, row_index, n_rows, first_row``."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"), F.min(row_index).alias("first_row"))
    counts = counts.where((F.col("n_rows") > 1) & (F.coalesce("key", F.lit("")) != ""))
    members = df.select(F.col(key).alias("key"), F.col(row_index).alias("row_index"))
    return members.join(counts, "key")


def duplicate_issues(df: DataFrame, row_index: str, key: str, template: str, label: str | None = None) -> DataFrame:
    """One error per row that shares its key, with the number of rows and the first of them (from 1).

    The members of a group are rows of ``duplicate_groups``, so no list is gathered in one task
    or copied to every member.
    """
    default, field = ("URL path", "url_path") if template == "practice" else ("slug", "slug")
    members = duplicate_groups(df, row_index, key)
    message = F.concat(
        F.lit(f'Duplicate {label or default} "'), X.truncate(F.col("key"), 40), F.lit('" found in '), F.col("n_rows").cast("string"),
        F.lit(" rows, first in row "), (F.col("first_row") + 1).cast("string"),
    )
    return members.select("row_index", F.lit(field).alias("field"), message.alias("message"), F.lit("error").alias("severity"))


def validate_prepared(df: DataFrame, row_index: str, record: str, status: str, template: str) -> DataFrame:
    """Issues of prepared rows that are not skipped, duplicates included."""
    live = df.where(F.col(status) != "skipped")
    key = "url_path" if template == "practice" else "slug"
    keyed = live.select(row_index, F.col(f"{record}.{key}").alias("_key"))
    found = issue_table(live, row_index, prepared_checks(F.col(record), F.col(status), template))
    return found.unionByName(duplicate_issues(keyed, row_index, "_key", template))


def scored_checks(record: Column, confidence: Column, template: str) -> Column:
    bad_title = _blank(record["title"]) | (record["title"] == "Untitled")
    if template == "practice":
        path = record["url_path"]
        slug_check = issue(_missing(path) | (path == "//"), "url_path", "URL path is required", "error")
    else:
        slug_check = issue(_blank(record["slug"]), "slug", "Slug is required", "error")
    low = confidence["overall"] < 0.5
    low_text = F.concat(
        F.lit("Low confidence score ("), F.floor(confidence["overall"] * 100 + 0.5).cast("string"), F.lit("%)")
    )
    flags = F.transform(
        confidence["flags"],
        lambda f: F.struct(
            F.lit("quality").alias("field"), F.replace(f, F.lit("_"), F.lit(" ")).alias("message"), F.lit("warning").alias("severity")
        ),
    )
    base = issues(issue(bad_title, "title", "Title is required", "error"), slug_check, issue(low, "confidence", low_text, "warning"))
    return F.concat(base, flags)


def validate_scored(df: DataFrame, row_index: str, record: str, confidence: str, template: str) -> DataFrame:
    key = "url_path" if template == "practice" else "slug"
    keyed = df.select(row_index, F.col(f"{record}.{key}").alias("_key"))
    found = issue_table(df, row_index, scored_checks(F.col(record), F.col(confidence), template))
    return found.unionByName(duplicate_issues(keyed, row_index, "_key", template, label="slug"))


def validation_totals(found: DataFrame) -> DataFrame:
    """One row: rows with errors, rows with warnings only, issues by severity."""
    per_row = found.groupBy("row_index").agg(
        F.bool_or(F.col("severity") == "error").alias("has_error"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    return per_row.agg(
        F.count_if("has_error").alias("error_rows"),
        F.count_if(~F.col("has_error")).alias("warning_rows"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_issues"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("warning_issues"),
    )


def form_checks(fields: Column) -> Column:
    """Form definition: every field needs a name (or html content), a label, and options where it offers a choice."""
    choices = ["select", "radio"]

    def one(f: Column) -> Column:
        is_html = f["type"] == "html"
        named = ~is_html & X.nonblank(f["name"])
        return F.array(
            F.when(is_html & _blank(f["html_content"]), "html content missing"),
            F.when(~is_html & _blank(f["name"]), "field name missing"),
            F.when(named & _blank(f["label"]), F.concat(F.lit('Field "'), f["name"], F.lit('" needs a label'))),
            F.when(
                named & f["type"].isin(choices) & (F.coalesce(F.size(f["options"]), F.lit(0)) <= 0),
                F.concat(F.lit('Field "'), f["name"], F.lit('" needs at least one option')),
            ),
        )

    return F.filter(F.flatten(F.transform(fields, one)), lambda m: m.isNotNull())
