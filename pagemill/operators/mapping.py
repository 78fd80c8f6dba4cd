"""Column mapping: source columns to template fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.functions.text import WS_CHARS, html_transform, markdown_to_html, nonblank, null_if_blank, null_if_empty, once, slugify
from pagemill.operators.templates import alias_lookup, mappable_fields, repeater_children
from pagemill.session import task_count


@dataclass
class FieldMapping:
    target: str
    source: str
    default: str | None = None
    transform: str = "none"


@dataclass
class Mapping:
    entries: list[FieldMapping] = field(default_factory=list)
    repeater_counts: dict[str, int] = field(default_factory=dict)

    def remap(self, source: str, target: str | None) -> "Mapping":
        """Point one column at a target; both sides are replaced."""
        kept = [e for e in self.entries if e.source != source and e.target != target]
        return Mapping(kept + ([FieldMapping(target, source)] if target else []), dict(self.repeater_counts))


def normalize_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"[-_{WS_CHARS}]+", "")


def _python_norm(name: str) -> str:
    return "".join(name.lower().replace("-", "").replace("_", "").split())


def _field_array(template: str) -> Column:
    return F.array(*[
        F.struct(
            F.lit(f.key).alias("key"), F.lit(_python_norm(f.key)).alias("norm"), F.lit(_python_norm(f.label)).alias("label")
        )
        for f in mappable_fields(template)
    ])


def _alias_map() -> Column:
    pairs = [F.lit(x) for pair in alias_lookup().items() for x in pair]
    return F.create_map(*pairs)


def match_field(name: Column, template: str) -> Column:
    """Field key for a column name: exact key, then alias, then substring either way."""
    fields = mappable_fields(template)
    exact = F.create_map(*[F.lit(x) for f in reversed(fields) for x in (_python_norm(f.key), f.key)])
    known = {f.key for f in fields}
    alias = F.create_map(*[F.lit(x) for a, k in alias_lookup().items() if k in known for x in (a, k)])

    def match(norm: Column) -> Column:
        partial = F.get(
            F.filter(_field_array(template), lambda f: F.contains(f["norm"], norm) | F.contains(norm, f["norm"])), F.lit(0)
        )["key"]
        return F.coalesce(F.try_element_at(exact, norm), F.try_element_at(alias, norm), partial)

    return once(normalize_name(name), match)


def suggestions(name: Column, template: str, used: list[str] | None = None) -> Column:
    """Ranked ``array<struct<key, score>>``; equal scores keep registry order."""
    fields = [f for f in mappable_fields(template) if f.key not in set(used or [])]
    registry = F.array(*[
        F.struct(F.lit(f.key).alias("key"), F.lit(_python_norm(f.key)).alias("norm"), F.lit(_python_norm(f.label)).alias("label"))
        for f in fields
    ])

    def either(a: Column, b: Column) -> Column:
        return F.contains(a, b) | F.contains(b, a)

    def rank(n: Column) -> Column:
        def score(f: Column, i: Column) -> Column:
            points = (
                F.when((f["norm"] == n["norm"]) | (f["label"] == n["norm"]), 100).when(f["key"] == n["alias"], 90)
                .when(either(f["norm"], n["norm"]), 60).when(either(f["label"], n["norm"]), 50)
            )
            return F.struct((-points).alias("rank"), i.alias("at"), f["key"].alias("key"))

        return F.array_sort(F.filter(F.transform(registry, score), lambda s: s["rank"].isNotNull()))

    ranked = once(
        once(normalize_name(name), lambda v: F.struct(v.alias("norm"), F.try_element_at(_alias_map(), v).alias("alias"))), rank
    )
    return F.transform(ranked, lambda s: F.struct(s["key"].alias("key"), (-s["rank"]).alias("score")))


def suggestions_table(columns: DataFrame, name: str, template: str, used: list[str] | None = None) -> DataFrame:
    """``name, ranked``: the suggestions of each distinct column name.

    Names are few and narrow but costly to rank, so they go to a named count of tasks. The ranking leaves
    a generator: a filter on it would else be pushed below the distinct names and rank every row that holds one.
    """
    names = columns.select(name).repartition(task_count(columns), F.col(f"`{name}`")).distinct()
    return names.select(name, F.explode(F.array(suggestions(F.col(f"`{name}`"), template, used))).alias("ranked"))


def auto_map_table(columns: DataFrame, name: str, order: str, template: str) -> DataFrame:
    """One source column per target, first by ``order``: ``target, source``."""
    matched = columns.select(F.col(name).alias("source"), F.col(order).alias("at"), match_field(F.col(name), template).alias("target"))
    return matched.where(F.col("target").isNotNull()).groupBy("target").agg(F.min_by("source", "at").alias("source"))


def auto_map(spark: SparkSession, columns: list[str], template: str) -> Mapping:
    """Suggested mapping for a header; the header is a control table."""
    if not columns:
        return Mapping()
    table = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "at int, source string")
    hits = table.select("at", "source", match_field(F.col("source"), template).alias("target")).collect()
    entries, taken = [], set()
    for row in sorted(hits, key=lambda r: r["at"]):
        if row["target"] and row["target"] not in taken:
            taken.add(row["target"])
            entries.append(FieldMapping(row["target"], row["source"]))
    return Mapping(entries)


def coverage(columns: DataFrame, name: str, mapping: DataFrame, source: str = "source") -> DataFrame:
    """Columns no mapping entry uses."""
    return columns.join(mapping, columns[name] == mapping[source], "left_anti")


def transform_text(c: Column, kind: str) -> Column:
    if kind == "html":
        return html_transform(c)
    if kind == "markdown":
        return markdown_to_html(c)
    if kind == "slugify":
        return slugify(c)
    return c


def _source_column(df: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name in df.columns else None


def mapped_columns(df: DataFrame, mapping: Mapping) -> dict[str, Column]:
    """Target field to Column; blank values fall to the default, else NULL."""
    out: dict[str, Column] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for e in mapping.entries:
        raw = _source_column(df, e.source)
        is_text = isinstance(types.get(e.source, T.StringType()), T.StringType)
        default = F.lit(e.default) if e.default else None
        if raw is None:
            value = default
        elif is_text:
            value = null_if_blank(raw)
            value = F.coalesce(value, default) if default is not None else value
            value = transform_text(value, e.transform)
        else:
            value = raw if default is None else F.coalesce(raw, default.cast(types[e.source]))
        if value is not None:
            out[e.target] = F.coalesce(value, out[e.target]) if e.target in out else value
    return out


def apply_mapping(df: DataFrame, mapping: Mapping, keep: list[str]) -> DataFrame:
    """Kept columns plus one column per target field."""
    cols = mapped_columns(df, mapping)
    return df.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in cols.items()])


def mirror_images(cols: dict[str, Column]) -> dict[str, Column]:
    """Hero image and featured image fill each other."""
    hero, featured = cols.get("hero.backgroundImage"), cols.get("featured_image")
    if hero is None and featured is None:
        return cols
    shared = F.coalesce(*[null_if_empty(c) for c in (hero, featured) if c is not None])
    return {
        **cols,
        "hero.backgroundImage": F.coalesce(shared, hero) if hero is not None else shared,
        "featured_image": F.coalesce(shared, featured) if featured is not None else shared,
    }


def repeater_items(df: DataFrame, template: str, parent: str, mapping: Mapping) -> Column | None:
    """Gather ``body_1, body_2 …`` or mapped ``key_i`` / ``key[i]`` columns to an array of structs.

    A native array column mapped to the parent passes. NULL when nothing matches.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    for e in mapping.entries:
        if e.target == parent and isinstance(types.get(e.source), T.ArrayType):
            return F.col(f"`{e.source}`")
    children = repeater_children(template, parent)
    by_target: dict[str, list[str]] = {}
    for e in mapping.entries:
        by_target.setdefault(e.target, []).append(e.source)
    items = []
    names = [*types, *by_target]
    indexed = [int(m[1]) for n in names if (m := re.search(r"_(\d{1,9})\Z", n))] + [int(m[1]) + 1 for n in names if (m := re.search(r"\[(\d{1,9})\]\Z", n))]
    highest = mapping.repeater_counts.get(parent) or max([0, *indexed])
    bases = {child.key.split(".")[-1] for child in children} | {child.key for child in children}
    present = sorted({i for i in indexed if i <= highest and any(f"{b}_{i}" in types or f"{b}_{i}" in by_target or f"{b}[{i - 1}]" in by_target for b in bases)})
    for i in present:
        values, seen = [], F.lit(False)
        used = False
        for child in children:
            base = child.key.split(".")[-1]
            value = F.lit(None).cast("string")
            for source in by_target.get(f"{child.key}_{i}", []) + by_target.get(f"{child.key}[{i - 1}]", []):
                if source in types:
                    value, used = F.coalesce(null_if_blank(F.col(f"`{source}`").cast("string")), value), True
            seen = seen | value.isNotNull()
            direct = f"{base}_{i}"
            if direct in types:
                # The plain name_i pattern serves only the first child that has data.
                found = F.when(~seen, null_if_blank(F.col(f"`{direct}`").cast("string")))
                value, used = F.coalesce(value, found), True
                seen = seen | value.isNotNull()
            values.append(value.alias(base))
        if used:
            items.append(F.when(seen, F.struct(*values)))
    if not items:
        return None
    return F.filter(F.array(*items), lambda s: s.isNotNull())


__all__ = [
    "FieldMapping", "Mapping", "match_field", "suggestions", "suggestions_table", "auto_map", "auto_map_table", "coverage",
    "apply_mapping", "mapped_columns", "mirror_images", "repeater_items", "transform_text", "nonblank",
]
