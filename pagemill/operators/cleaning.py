"""Cleaning of source records: shortcodes, encoding, white space, markup."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagemill.functions import html as H
from pagemill.functions import text as X
from pagemill.operators.blocks import FilterOptions, filter_secondary
from pagemill.operators.tokens import distribute, main_content_of_cells

# Columns that hold page bodies, and when another column counts as one.
CONTENT_COLUMNS = re.compile(
    r"^(body|content|html|main_content|description|text|markdown|post_content|article|page_content)$", re.I
)
LONG_VALUE_CHARS = 500
LOG_TYPE = "array<struct<field:string,action:string,detail:string>>"

# Log wording per step.
STEPS = [
    ("strip_shortcodes", "Removed CMS shortcodes", X.strip_shortcodes),
    ("fix_encoding", "Fixed character encoding issues", X.fix_encoding),
    ("normalize_whitespace", "Normalized whitespace", X.normalize_whitespace),
    ("clean_empty_html", "Removed empty HTML wrappers", H.clean_empty_html),
]
NORMALIZE_ACTION = ("normalize_html", "Normalized HTML (URLs, inline markup, headings, dedup)")


@dataclass
class CleaningOptions:
    source_domain: str | None = None
    filters: FilterOptions = field(default_factory=FilterOptions)


def is_content_value(name: str, value: Column) -> Column:
    if CONTENT_COLUMNS.match(name):
        return F.lit(True)
    return F.coalesce((F.length(value) > LONG_VALUE_CHARS) & value.rlike(X.HTML_HINT), F.lit(False))


def finish_body(c: Column, options: CleaningOptions) -> Column:
    """The steps after main-content extraction, in their fixed order."""
    c = filter_secondary(c, options.filters)["html"]
    if options.source_domain:
        c = H.absolute_urls(c, H.origin_of(options.source_domain))
    c = H.clean_inline_markup(c)
    c = H.normalize_headings(c)
    c = H.remove_duplicate_blocks(c)
    return X.squeeze_newlines(H.remove_empty_elements(c))


def normalize_html(df: DataFrame, key: str, html: str, options: CleaningOptions | None = None) -> DataFrame:
    """Main content, secondary filter, URLs, inline markup, headings, duplicates, empties."""
    options = options or CleaningOptions()
    return main_content_of_cells(df, key, {html: F.lit(True)}, lambda c: finish_body(c, options))


def clean_records(df: DataFrame, key: str, options: CleaningOptions | None = None) -> DataFrame:
    """Clean every string column; adds ``cleaning_log`` with the steps that changed a value."""
    options = options or CleaningOptions()
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    # One plain column per value and step: the optimizer keeps them apart because each is used more than once.
    out, logs = df, {n: [] for n in names}
    before = {n: F.col(f"`{n}`") for n in names}
    for i, (action, detail, step) in enumerate(STEPS):
        out = out.select("*", *[step(before[n]).alias(f"_c{i}_{n}") for n in names])
        for n in names:
            after = F.col(f"`_c{i}_{n}`")
            logs[n].append(
                F.when(
                    X.nonblank(F.col(f"`{n}`")) & ~before[n].eqNullSafe(after),
                    F.struct(F.lit(n).alias("field"), F.lit(action).alias("action"), F.lit(detail).alias("detail")),
                )
            )
            before[n] = after
    logs = [entry for n in names for entry in logs[n]]
    log = F.filter(F.array(*logs), lambda e: e.isNotNull()) if logs else F.array()
    keep = [c for c in df.columns if c not in names]
    cleaned = [
        F.when(X.nonblank(F.col(f"`{n}`")), F.col(f"`_c{len(STEPS) - 1}_{n}`")).otherwise(F.col(f"`{n}`")).alias(n) for n in names
    ]
    staged = out.select(*[f"`{c}`" for c in keep], *cleaned, log.cast(LOG_TYPE).alias("cleaning_log"))
    if not names:
        return distribute(staged, key)
    # The body steps: keep the value before them to see what changed.
    bodies = {n: is_content_value(n, F.col(f"`{n}`")) for n in names}
    before = F.transform(
        F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.col(f"`{n}`")).alias("h")) for n in names]), lambda x: x
    )
    done = main_content_of_cells(staged.withColumn("_before", before), key, bodies, lambda c: finish_body(c, options))
    after = F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.col(f"`{n}`")).alias("h")) for n in names])
    changed = F.filter(F.zip_with("_before", after, lambda b, a: F.when(b["h"] != a["h"], b["n"])), lambda n: n.isNotNull())
    extra = F.transform(
        changed,
        lambda n: F.struct(n.alias("field"), F.lit(NORMALIZE_ACTION[0]).alias("action"), F.lit(NORMALIZE_ACTION[1]).alias("detail")),
    )
    return done.withColumn("cleaning_log", F.concat("cleaning_log", extra)).select(*[f"`{c}`" for c in df.columns], "cleaning_log")
