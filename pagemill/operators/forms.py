"""CMS forms: lookups in content, usage, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions.text import strip_ws
from pagemill.functions.urls import cms_path

# How content refers to a form.
FORM_MARK = r"\{\{form:([^}]+)\}\}"
FORM_NAME = r'"formName"\s*:\s*"((?:[^"\\]|\\.)*)"'
CONTACT_BLOCK = r'"type"\s*:\s*"contact-section"'
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"


def form_lookups(content: Column) -> Column:
    """``struct<ids, names>`` of the forms a JSON text refers to, without repeats."""
    found = F.concat(
        F.regexp_extract_all(content, F.lit(FORM_MARK), F.lit(1)),
        F.regexp_extract_all(content, F.lit(FORM_NAME), F.lit(1)),
    )
    found = F.filter(F.transform(found, strip_ws), lambda v: v != "")
    contact = F.when(content.rlike(CONTACT_BLOCK), F.array(F.lit("contact-block"))).otherwise(F.array().cast("array<string>"))
    ids = F.array_distinct(F.filter(found, lambda v: v.rlike(UUID)))
    names = F.array_distinct(F.concat(contact, F.filter(found, lambda v: ~v.rlike(UUID))))
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(ids, none).alias("ids"), F.coalesce(names, none).alias("names"))


def merge_lookups(*lookups: Column) -> Column:
    ids, names = lookups[0]["ids"], lookups[0]["names"]
    for other in lookups[1:]:
        ids, names = F.array_union(ids, other["ids"]), F.array_union(names, other["names"])
    return F.struct(ids.alias("ids"), names.alias("names"))


def route_lookups(path: Column, *contents: Column) -> Column:
    """Lookups of a route: its contents, and the contact form on the home and contact pages."""
    built_in = cms_path(path).isin("/", "/contact/")
    extra = F.struct(
        F.array().cast("array<string>").alias("ids"),
        F.when(built_in, F.array(F.lit("contact"))).otherwise(F.array().cast("array<string>")).alias("names"),
    )
    return merge_lookups(extra, *[form_lookups(c) for c in contents])


def form_usage(pages: DataFrame, forms: DataFrame, page_key: str, path: str, content: str) -> DataFrame:
    """Which page uses which form: ``form_id, form_name, page``. Two equi joins, one per kind of lookup."""
    looked = pages.select(F.col(page_key).alias("page"), route_lookups(F.col(path), F.col(content)).alias("l"))
    f = forms.select(F.col("id").alias("form_id"), F.col("name").alias("form_name"))
    by_id = looked.select("page", F.explode("l.ids").alias("form_id")).join(f, "form_id")
    by_name = looked.select("page", F.explode("l.names").alias("form_name")).join(f, "form_name")
    return by_id.select("form_id", "form_name", "page").unionByName(by_name.select("form_id", "form_name", "page")).distinct()


def route_forms(routes: DataFrame, lookups: str, key: str, forms: DataFrame) -> DataFrame:
    """Forms each route needs, once per form id."""
    by_id = routes.select(key, F.explode(f"{lookups}.ids").alias("id")).join(forms, "id")
    by_name = routes.select(key, F.explode(f"{lookups}.names").alias("name")).join(forms, "name")
    cols = [key] + forms.columns
    return by_id.select(*cols).unionByName(by_name.select(*cols)).dropDuplicates([key, "id"])


def submission(values: Column) -> Column:
    """``map<string, array<string>>`` to one text per key: lists joined, empty keys dropped."""
    joined = F.transform_values(values, lambda _k, v: F.array_join(F.filter(v, lambda x: x.isNotNull()), ", "))
    return F.map_filter(joined, lambda k, _v: F.size(F.try_element_at(values, k)) > 0)
