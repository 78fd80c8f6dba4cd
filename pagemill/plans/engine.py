"""The import pipeline: clean, map, apply rules, build, de-collide, score, route.

One lazy plan. It shuffles twice: once by record for the page bodies, once for slugs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagemill.functions import text as X
from pagemill.functions.dates import iso_utc, publish_date_or
from pagemill.functions.urls import import_slug
from pagemill.operators import sections as S
from pagemill.operators.blocks import FilterOptions
from pagemill.operators.cleaning import CleaningOptions, clean_records
from pagemill.operators.mapping import Mapping, mapped_columns, mirror_images, repeater_items
from pagemill.operators.rules import HERO_TYPE, Fields, Recipe, run_rule
from pagemill.operators.scoring import FIELD_SCORE_TYPE, route, score_record
from pagemill.operators.slugs import resolve_collisions
from pagemill.operators.validation import quick_checks
from pagemill.session import checkpoint

LOG_TYPE = (
    "array<struct<rule_id:string,target_field:string,rule_type:string,ai_used:boolean,confidence:double,description:string>>"
)
HERO_FIELDS = ["sectionLabel", "tagline", "description", "backgroundImage", "backgroundImageAlt"]
FAQ_TITLE = "Frequently Asked Questions"


@dataclass
class EngineOptions:
    template: str = "practice"
    site_name: str = ""
    source_domain: str | None = None
    slug_mode: str = "skip"
    max_suffix: int | None = None
    imported_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def cleaning(self) -> CleaningOptions:
        return CleaningOptions(self.source_domain, FilterOptions(self.template, remove_contact=self.template == "practice"))

    def import_time(self) -> Column:
        return F.lit(self.imported_at.astimezone(timezone.utc).isoformat()).cast("timestamp")


def _is_true(*cols: Column) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(c.cast("string") == "true", F.lit(False))
    return out


def map_records(df: DataFrame, key: str, mapping: Mapping, template: str, repeaters: bool = False) -> DataFrame:
    """``key``, a struct ``mapped`` with one field per mapped target, and the ``source`` struct.

    With ``repeaters``, also ``rep_sections`` and ``rep_faq`` gathered from repeated columns.
    """
    cols = mapped_columns(df, mapping)
    cols = mirror_images(cols) if template == "practice" else cols
    fields = [v.alias(k) for k, v in cols.items()] or [F.lit(None).cast("string").alias("title")]
    keep = [F.col(f"`{c}`") for c in df.columns if c != key]
    gathered = []
    if repeaters:
        for name, parent, ddl in (("rep_sections", "contentSections", S.SECTION_TYPE), ("rep_faq", "faq.items", S.FAQ_TYPE)):
            items = repeater_items(df, template, parent, mapping)
            gathered.append((F.lit(None).cast(ddl) if items is None else _as_items(df, items, ddl)).alias(name))
    return df.select(key, F.struct(*fields).alias("mapped"), F.struct(F.lit(0).alias("_"), *keep).alias("source"), *gathered)


def _as_items(df: DataFrame, items: Column, ddl: str) -> Column:
    """Array of structs brought to a full item type by field name."""
    have = df.select(items.alias("x")).schema["x"].dataType.elementType
    want = T._parse_datatype_string(ddl).elementType
    names = set(have.fieldNames()) if isinstance(have, T.StructType) else set()
    return F.transform(
        items,
        lambda s: F.struct(*[
            (s[f.name].cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields
        ]),
    )


def _fields(df: DataFrame) -> Fields:
    return Fields({f.name: F.col("mapped").getField(f.name) for f in df.schema["mapped"].dataType.fields})


def apply_rules(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Add ``out`` (one field per target), ``field_scores``, ``log`` and ``rule_errors``; a later value wins over an earlier one."""
    fields = _fields(df)
    stages, scores, logs, errors = [], [], [], []
    values: dict[str, Column] = {}
    for i, rule in enumerate(r for r in recipe.rules if r.enabled):
        result = run_rule(rule, fields)
        stages.append(result.outcome.alias(f"_r{i}"))
        if result.error is not None:
            errors.append(result.error.cast("string"))
        got = F.col(f"_r{i}")
        value = got["value"]
        if rule.target in values and rule.rule_type not in ("ai_transform", "ignore"):
            value = F.coalesce(value, values[rule.target])
        if rule.rule_type not in ("ai_transform", "ignore"):
            values[rule.target] = value
        scores.append(F.struct(F.lit(rule.target).alias("field"), got["score"].alias("score"), got["category"].alias("category"), got["reason"].alias("reason")))
        logs.append(
            F.struct(
                F.lit(rule.id).alias("rule_id"), F.lit(rule.target).alias("target_field"), F.lit(rule.rule_type).alias("rule_type"),
                F.lit(result.ai_used).alias("ai_used"), got["score"].alias("confidence"), got["description"].alias("description"),
            )
        )
    staged = df.select("*", *stages)
    out = F.struct(*[v.alias(k) for k, v in values.items()]) if values else F.struct(F.lit(None).cast("string").alias("_"))
    score_col = F.array(*scores).cast(FIELD_SCORE_TYPE) if scores else F.array().cast(FIELD_SCORE_TYPE)
    log_col = F.array(*logs).cast(LOG_TYPE) if logs else F.array().cast(LOG_TYPE)
    error_col = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array().cast("array<string>")
    return staged.select(*df.columns, out.alias("out"), score_col.alias("field_scores"), log_col.alias("log"), error_col.alias("rule_errors"))


def _outputs(df: DataFrame) -> Fields:
    if "out" not in df.columns:
        return Fields({})
    return Fields({f.name: F.col("out").getField(f.name) for f in df.schema["out"].dataType.fields if f.name != "_"})


def _truthy(c: Column) -> Column:
    return X.null_if_empty(c)


def _array_output(df: DataFrame, name: str, ddl: str) -> Column:
    kinds = {f.name: f.dataType for f in df.schema["out"].dataType.fields} if "out" in df.columns else {}
    if isinstance(kinds.get(name), (T.ArrayType, T.StructType)):
        return F.col("out").getField(name).cast(ddl)
    return F.lit(None).cast(ddl)


def build_practice(df: DataFrame, key: str, options: EngineOptions, extract: bool = True) -> DataFrame:
    """Practice page struct ``record`` from ``mapped`` (and ``out`` when rules ran).

    The default structure is always built; rule outputs lie over it. Gathered repeater columns,
    where ``map_records`` made them, come before the body, as the preparation step does. ``extract=False``
    skips structure extraction: the body stays one section.
    """
    m, o = _fields(df), _outputs(df)
    title = F.coalesce(o.text("title"), m.text("title"), F.lit("Untitled"))
    wanted = F.coalesce(_truthy(o.text("url_path", "url_slug")), _truthy(m.text("url_slug")))
    df = df.withColumn("_title", title)
    slug = F.when(wanted.isNotNull(), import_slug(wanted, F.col("_title"))).otherwise(X.slugify(F.col("_title")))
    df = df.withColumn("_slug", slug)
    raw = _truthy(m.text("contentSections.body", "body", "content"))
    prepared = "rep_sections" in df.columns
    if prepared:
        raw = F.when(F.coalesce(F.size("rep_sections"), F.lit(0)) <= 0, raw)
    df = df.withColumn("_body", F.coalesce(S.clean_body(raw), F.lit("")))
    none_faq = F.array().cast(S.FAQ_TYPE)
    found = F.when(F.col("_body") != "", S.detect_faq(F.col("_body"))).otherwise(none_faq)
    if prepared:
        found = F.when(F.coalesce(F.size("rep_faq"), F.lit(0)) > 0, F.col("rep_faq")).otherwise(found)
    df = df.withColumn("_faq", found if extract else none_faq)
    df = df.withColumn("_rest", F.when(F.size("_faq") > 0, S.remove_faq(F.col("_body"), F.col("_faq"))).otherwise(F.col("_body")))
    df = df.withColumn(
        "_faq",
        F.transform("_faq", lambda q: F.struct(q["question"].alias("question"), X.ensure_html(F.coalesce(q["answer"], F.lit(""))).alias("answer"))),
    )
    bodies = S.drop_thin_sections(S.split_sections(F.col("_rest"))) if extract else F.array(F.col("_rest"))
    empty = F.array().cast(S.SECTION_TYPE)
    made = F.when(F.col("_rest") != "", S.sections_from_bodies(bodies)).otherwise(empty)
    if prepared:
        given = S.normalize_sections(F.col("rep_sections"))
        made = F.when(F.coalesce(F.size("rep_sections"), F.lit(0)) > 0, given).otherwise(made)
    df = df.withColumn("_made", made)
    if not prepared and extract:
        df = df.withColumn("_made", S.extract_section_images(F.col("_made")))
    rule_faq = _array_output(df, "faq", S.FAQ_TYPE)
    rule_sections = _array_output(df, "contentSections", S.SECTION_TYPE)
    df = df.withColumn("_faq", F.when(F.coalesce(F.size(rule_faq), F.lit(0)) > 0, rule_faq).otherwise(F.col("_faq")))
    picked = F.when(F.coalesce(F.size(rule_sections), F.lit(0)) > 0, rule_sections).otherwise(F.col("_made"))
    cleaned = F.transform(
        S.normalize_sections(picked),
        lambda s: F.struct(
            S.clean_body(s["body"], F.col("_faq")).alias("body"), s["image"].alias("image"), s["imageAlt"].alias("imageAlt"),
            s["imagePosition"].alias("imagePosition"), s["showCTAs"].alias("showCTAs"),
        ),
    )
    df = df.withColumn("_sections", cleaned)
    if prepared and extract:
        df = df.withColumn("_sections", S.extract_section_images(F.col("_sections")))
    hero_image = F.coalesce(_truthy(m.text("hero.backgroundImage")), _truthy(m.text("featured_image")), F.lit(""))
    hero_default = {
        "sectionLabel": F.coalesce(_truthy(m.text("hero.sectionLabel")), F.col("_title")),
        "tagline": F.coalesce(m.text("hero.tagline"), F.lit("")),
        "description": F.coalesce(X.ensure_html(_truthy(m.text("hero.description"))), F.lit("")),
        "backgroundImage": hero_image,
        "backgroundImageAlt": F.coalesce(m.text("hero.backgroundImageAlt"), F.lit("")),
    }
    hero_out = _array_output(df, "hero", HERO_TYPE)
    hero = F.struct(*[F.coalesce(hero_out[f], o.text(f"hero.{f}"), hero_default[f]).alias(f) for f in HERO_FIELDS])
    has_faq = F.size("_faq") > 0
    faq_heading = F.coalesce(o.text("faq.heading"), m.text("faq.heading"))
    faq = F.struct(
        (has_faq | (F.coalesce(m.text("faq.heading"), F.lit("")) != "") | (F.coalesce(o.text("faq.heading"), F.lit("")) != "")).alias("enabled"),
        F.coalesce(faq_heading, F.when(has_faq, FAQ_TITLE).otherwise("")).alias("heading"),
        F.coalesce(o.text("faq.description"), m.text("faq.description"), F.lit("")).alias("description"),
        F.col("_faq").alias("items"),
    )
    social = F.struct(
        F.lit("awards").alias("mode"), F.array().cast("array<string>").alias("testimonials"),
        F.struct(F.array().cast("array<struct<src:string,alt:string>>").alias("logos")).alias("awards"),
    )
    date = publish_date_or(F.coalesce(o.text("published_at"), m.text("published_at")), options.import_time())
    meta_title = F.concat(F.col("_title"), F.lit(f" | {options.site_name}")) if options.site_name else F.col("_title")
    df = df.withColumn("_date", date)
    record = F.struct(
        F.col("_title").alias("title"),
        F.when(F.startswith("_slug", F.lit("/")), F.col("_slug")).otherwise(F.concat(F.lit("/"), F.col("_slug"), F.lit("/"))).alias("url_path"),
        F.lit("practice").alias("page_type"),
        F.struct(hero.alias("hero"), social.alias("socialProof"), F.col("_sections").alias("contentSections"), faq.alias("faq")).alias("content"),
        F.coalesce(o.text("meta_title"), m.text("meta_title"), meta_title).alias("meta_title"),
        F.coalesce(_truthy(o.text("meta_description")), _truthy(m.text("meta_description"))).alias("meta_description"),
        *[F.coalesce(o.text(n), m.text(n)).alias(n) for n in ("canonical_url", "og_title", "og_description", "og_image")],
        _is_true(o.get("noindex"), m.get("noindex")).alias("noindex"),
        F.lit(None).cast("string").alias("schema_type"), F.lit(None).cast("string").alias("schema_data"),
        iso_utc(F.col("_date.published_at")).alias("published_at"), F.col("_date.publish_date_source").alias("publish_date_source"),
        F.lit("draft").alias("status"),
    )
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, record.alias("record"))


def build_post(df: DataFrame, key: str, options: EngineOptions, prepare: bool = False) -> DataFrame:
    """Blog post struct ``record`` from ``mapped`` (and ``out`` when rules ran)."""
    m, o = _fields(df), _outputs(df)
    df = df.withColumn("_title", F.coalesce(o.text("title"), m.text("title"), F.lit("Untitled")))
    given = F.coalesce(o.text("slug"), m.text("slug"))
    slug = F.coalesce(_truthy(given) if prepare else given, X.slugify(F.col("_title")))

    def pick(*names: str) -> Column:
        return F.coalesce(*[_truthy(x.text(n)) for n in names for x in (o, m)])

    body = pick("body")
    date = publish_date_or(F.coalesce(o.text("published_at"), m.text("published_at")), options.import_time())
    df = df.withColumn("_date", date)
    record = F.struct(
        F.col("_title").alias("title"), slug.alias("slug"), pick("excerpt").alias("excerpt"),
        pick("featured_image").alias("featured_image"), pick("category").alias("category"),
        F.lit(None).cast("string").alias("category_id"), F.array().cast("array<string>").alias("content"),
        (X.ensure_html(body) if prepare else body).alias("body"),
        F.coalesce(o.text("meta_title"), m.text("meta_title"), F.col("_title")).alias("meta_title"),
        F.coalesce(pick("meta_description"), _truthy(m.text("excerpt"))).alias("meta_description"),
        *[F.coalesce(o.text(n), m.text(n)).alias(n) for n in ("canonical_url", "og_title", "og_description")],
        F.coalesce(o.text("og_image"), m.text("og_image"), o.text("featured_image"), m.text("featured_image")).alias("og_image"),
        _is_true(o.get("noindex"), m.get("noindex")).alias("noindex"),
        iso_utc(F.col("_date.published_at")).alias("published_at"), F.col("_date.publish_date_source").alias("publish_date_source"),
        F.lit("draft").alias("status"),
    )
    keep = [c for c in df.columns if not c.startswith("_")]
    return df.select(*keep, record.alias("record"))


def build_records(df: DataFrame, key: str, options: EngineOptions) -> DataFrame:
    return build_practice(df, key, options) if options.template == "practice" else build_post(df, key, options)


def run_recipe(df: DataFrame, key: str, mapping: Mapping, recipe: Recipe, options: EngineOptions, failed: Column | None = None) -> DataFrame:
    """Full pipeline: ``key, record, confidence, status, log, cleaning_log``.

    ``key`` is the unique source index. A row on which a rule cannot run (``RuleResult.error``), or for which ``failed``
    holds, becomes an empty record with score 0, the flag ``processing_error`` and the error in its log; it still takes
    part in the output, but not in slug collisions.
    """
    marked = df if failed is None else df.withColumn("__failed", failed)
    cleaned = clean_records(marked, key, options.cleaning())
    mapped = map_records(cleaned, key, mapping, options.template)
    built = build_records(apply_rules(mapped, recipe), key, options)
    slug = "url_path" if options.template == "practice" else "slug"
    catches = failed is not None or any(run_rule(r, Fields({})).error is not None for r in recipe.rules if r.enabled)
    bad = (F.col("source.__failed") if failed is not None else F.lit(False)) | (F.size("rule_errors") > 0)
    built = built.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    # A failed row takes no slug from others.
    built = built.withColumn("_slug", F.when(~F.col("_bad"), F.col(f"record.{slug}")) if catches else F.col(f"record.{slug}"))
    # Of the source only its log is asked for from here on.
    built = built.select(key, "record", "field_scores", "log", "rule_errors", F.col("source.cleaning_log").alias("cleaning_log"), "_bad", "_slug")
    if options.slug_mode == "unique_suffix":
        # Slugs are read several times; the built records are written once instead of built again.
        built = checkpoint(built)
    built = resolve_collisions(built, key, "_slug", options.template, options.slug_mode, options.max_suffix)
    built = built.withColumn("record", F.col("record").withField(slug, F.col("_slug"))).drop("_slug")
    # The score is costly and read several times: it leaves a generator, so that the optimizer does not copy it to each place.
    score = score_record(F.col("record"), options.template, F.col("field_scores"), F.col("log"), recipe.uses_ai)
    scored = built.select("*", F.explode(F.array(score)).alias("confidence"))
    status = route(F.col("confidence.overall"), recipe.threshold)
    if catches:
        scored = _blank_failed(scored, F.col("_bad"), F.get("rule_errors", F.lit(0)))
        status = F.when(F.col("_bad"), "needs_review").otherwise(status)
    return scored.withColumn("status", status).select(
        key, "record", "confidence", "status", "log", "cleaning_log"
    )


def _blank_failed(df: DataFrame, bad: Column, error: Column) -> DataFrame:
    """Empty record, score 0 and an error entry for failed rows."""
    record = F.col("record")
    empty_dims = F.array().cast(df.schema["confidence"].dataType["dimensions"].dataType)
    blank_conf = F.struct(
        F.lit(0.0).alias("overall"), empty_dims.alias("dimensions"), F.array().cast(FIELD_SCORE_TYPE).alias("field_scores"),
        F.array(F.lit("processing_error")).alias("flags"),
    )
    entry = F.array(F.struct(
        F.lit("error").alias("rule_id"), F.lit("*").alias("target_field"), F.lit("direct_map").alias("rule_type"),
        F.lit(False).alias("ai_used"), F.lit(0.0).alias("confidence"), F.concat(F.lit("Processing error"), F.coalesce(F.concat(F.lit(": "), error), F.lit(""))).alias("description"),
    )).cast(LOG_TYPE)
    keep = {"title", "published_at", "publish_date_source", "status", "page_type"}
    fields = []
    for f in df.schema["record"].dataType.fields:
        value = record[f.name]
        if f.name == "url_path":
            value = F.concat(F.lit("/"), X.slugify(record["title"]), F.lit("/"))
        elif f.name == "slug":
            value = X.slugify(record["title"])
        elif f.name not in keep:
            value = F.lit(None).cast(f.dataType)
        fields.append(value.alias(f.name))
    return (
        df.withColumn("confidence", F.when(bad, blank_conf).otherwise(F.col("confidence")))
        .withColumn("log", F.when(bad, entry).otherwise(F.col("log")))
        .withColumn("record", F.when(bad, F.struct(*fields)).otherwise(record))
    )


def prepare_records(df: DataFrame, key: str, mapping: Mapping, options: EngineOptions) -> DataFrame:
    """``key, status, auto, current, issues``: the automatic version of every record, ready for review."""
    mapped = map_records(df, key, mapping, options.template, repeaters=options.template == "practice")
    if options.template == "practice":
        built = build_practice(mapped, key, options)
    else:
        built = build_post(mapped, key, options, prepare=True)
    return built.select(
        key, F.lit("needs-review").alias("status"), F.col("record").alias("auto"), F.col("record").alias("current"),
        quick_checks(F.col("record"), options.template).alias("issues"),
    )


def reset_to_auto(prepared: DataFrame, chosen: Column, template: str) -> DataFrame:
    """Put chosen rows back to their automatic version and to review."""
    return (
        prepared.withColumn("current", F.when(chosen, F.col("auto")).otherwise(F.col("current")))
        .withColumn("status", F.when(chosen, "needs-review").otherwise(F.col("status")))
        .withColumn("issues", quick_checks(F.col("current"), template))
    )


def transform_plain(df: DataFrame, key: str, mapping: Mapping, options: EngineOptions) -> DataFrame:
    """Older form without structure extraction: ``key, record``."""
    mapped = map_records(df, key, mapping, options.template)
    if options.template == "practice":
        built = build_practice(mapped, key, options, extract=False)
    else:
        built = build_post(mapped, key, options)
    blanked = F.col("record")
    for name in ("canonical_url", "og_title", "og_description", "og_image"):
        blanked = blanked.withField(name, F.lit(None).cast("string"))
    return built.select(key, blanked.alias("record"))


def engine_totals(results: DataFrame, key: str) -> DataFrame:
    """One row of counts; the exceptions themselves are ``results.where(status = 'needs_review')``."""
    failed = F.array_contains("confidence.flags", "processing_error")
    return results.agg(
        F.count_if(F.col("status") == "auto_approved").alias("auto_approved"),
        F.count_if((F.col("status") == "needs_review") & ~failed).alias("needs_review"),
        F.count_if(failed).alias("failed"),
        F.count("*").alias("total"),
    )
