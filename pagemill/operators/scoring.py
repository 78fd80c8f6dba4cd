"""Confidence of a transformed record: five weighted dimensions, flags and field scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions import text as X
from pagemill.functions.urls import is_image_url, strip_slashes

# Dimension weights, without and with model-backed rules.
WEIGHTS = {
    False: {"structural": 0.30, "extraction": 0.25, "content_quality": 0.25, "validation": 0.15, "ai_ambiguity": 0.05},
    True: {"structural": 0.25, "extraction": 0.20, "content_quality": 0.20, "validation": 0.15, "ai_ambiguity": 0.20},
}
FIELD_SCORE_TYPE = "array<struct<field:string,score:double,category:string,reason:string>>"
ENTITY = r"(?i)&(?:[a-z]+|#\d+);"


def _texts(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda d: d.isNotNull())


def _or_default(details: Column, text: str) -> Column:
    return F.when(F.size(details) == 0, F.array(F.lit(text))).otherwise(details)


def _minus(*terms: tuple[Column, float]) -> list[Column]:
    return [F.when(F.coalesce(cond, F.lit(False)), amount).otherwise(0.0) for cond, amount in terms]


def category_mean(field_scores: Column, category: str) -> Column:
    """Mean score of the fields in one category, NULL without any."""
    picked = F.filter(field_scores, lambda f: f["category"] == category)
    return X.once(
        picked,
        lambda p: F.when(F.size(p) > 0, F.aggregate(p, F.lit(0.0), lambda a, f: a + f["score"]) / F.size(p)),
    )


def _blend(score: Column, mean: Column) -> Column:
    return X.clamp01(F.when(mean.isNotNull(), (score + mean) / 2).otherwise(score))


def _missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _dimension(score: Column, details: Column, *flags: Column) -> Column:
    return F.struct(
        score.alias("score"), details.alias("details"),
        (_texts(*flags) if flags else F.array().cast("array<string>")).alias("flags"),
    )


def structural(record: Column, template: str, field_scores: Column) -> Column:
    no_title = _missing(record["title"]) | (record["title"] == "Untitled")
    if template == "practice":
        no_path = _missing(record["url_path"]) | (record["url_path"] == "//")
        no_hero = record["content"]["hero"].isNull()
        no_sections = F.coalesce(F.size(record["content"]["contentSections"]), F.lit(0)) <= 0
        checks = [
            (no_title, 0.3, "Missing or default title", "missing_title"),
            (no_path, 0.3, "Missing URL path", "missing_url_path"),
            (no_hero, 0.2, "Missing hero section", "missing_hero"),
            (no_sections, 0.1, "No content sections", "empty_sections"),
        ]
    else:
        checks = [
            (no_title, 0.3, "Missing or default title", "missing_title"),
            (_missing(record["slug"]), 0.3, "Missing slug", "missing_slug"),
        ]
    score = F.lit(1.0)
    for term in _minus(*[(c, amount) for c, amount, _d, _f in checks]):
        score = score - term
    details = _or_default(_texts(*[F.when(c, d) for c, _a, d, _f in checks]), "All required fields present")
    return _dimension(_blend(score, category_mean(field_scores, "structural")), details, *[F.when(c, f) for c, _a, _d, f in checks])


def extraction(record: Column, template: str, field_scores: Column) -> Column:
    if template == "practice":
        n = F.coalesce(F.size(record["content"]["contentSections"]), F.lit(0))
        n_faq = F.coalesce(F.size(record["content"]["faq"]["items"]), F.lit(0))
        hero = record["content"]["hero"]
        image = ~_missing(hero["backgroundImage"])
        score = (
            F.lit(0.8) + F.when(n >= 2, 0.1).when(n == 1, 0.0).otherwise(-0.2)
            + F.when(n_faq >= 2, 0.05).otherwise(0.0) + F.when(image, 0.05).otherwise(0.0)
        )
        details = _texts(
            F.when(n >= 2, F.concat(n.cast("string"), F.lit(" content sections extracted")))
            .when(n == 1, "Only 1 content section — body may not have H2 headings").otherwise("No content sections extracted"),
            F.when(n_faq >= 2, F.concat(n_faq.cast("string"), F.lit(" FAQ items extracted"))),
            F.when(image, "Hero image extracted"),
            F.when(F.length(hero["description"]) > 20, "Hero description extracted"),
        )
        flags = [F.when(n <= 0, "no_extraction")]
    else:
        short = F.coalesce(F.length(record["body"]), F.lit(0)) <= 100
        score = F.lit(0.8) - F.when(short, 0.2).otherwise(0.0)
        details = _texts(
            F.when(short, "Body content is short or missing").otherwise("Body content present"),
            F.when(~_missing(record["excerpt"]), "Excerpt present"),
        )
        flags = [F.when(short, "short_body")]
    return _dimension(_blend(score, category_mean(field_scores, "extraction")), details, *flags)


def content_quality(record: Column, template: str) -> Column:
    if template == "practice":
        thin = F.size(F.filter(
            record["content"]["contentSections"],
            lambda s: F.length(X.strip_ws(X.strip_tags(F.coalesce(s["body"], F.lit(""))))) < 20,
        ))
        n_thin, plain = F.greatest(F.coalesce(thin, F.lit(0)), F.lit(0)), F.lit(None).cast("int")
    else:
        n_thin = F.lit(0)
        plain = F.when(~_missing(record["body"]), F.length(X.strip_ws(X.strip_tags(record["body"]))))
    facts = X.once(
        F.to_json(record),
        lambda text: F.struct(
            text.rlike(X.SHORTCODE_REMNANT).alias("remnants"), (F.regexp_count(text, F.lit(ENTITY)) > 50).alias("entities"),
            F.when(~_missing(record["title"]), F.length(record["title"])).alias("title"), n_thin.alias("thin"), plain.alias("plain"),
        ),
    )
    return X.once(facts, _quality_of)


def _quality_of(f: Column) -> Column:
    title, thin, plain = f["title"], f["thin"], f["plain"]
    score = F.lit(0.9)
    for term in _minus((title < 5, 0.15), (title > 100, 0.05), (f["remnants"], 0.3), (f["entities"], 0.1)):
        score = score - term
    score = score - F.lit(0.1) * F.least(thin, F.lit(3)) - F.when(plain < 100, 0.15).otherwise(0.0)
    details = _texts(
        F.when(title < 5, "Title too short (<5 chars)").when(title > 100, "Title very long (>100 chars)")
        .when(title.between(10, 80), "Title length is good"),
        F.when(f["remnants"], "Shortcode remnants detected"),
        F.when(f["entities"], "Excessive HTML entities detected"),
        F.when(thin > 0, F.concat(thin.cast("string"), F.lit(" section(s) with very short/empty body"))),
        F.when(plain < 100, "Body content very short (<100 chars)").when(plain > 200, "Body content length adequate"),
    )
    return _dimension(
        X.clamp01(score), _or_default(details, "Content quality checks passed"),
        F.when(title < 5, "short_title"), F.when(f["remnants"], "shortcode_remnants"), F.when(f["entities"], "encoding_issues"),
        F.when(thin > 0, "empty_section_bodies"), F.when(plain < 100, "short_body"),
    )


def validation(record: Column, template: str) -> Column:
    if template == "practice":
        slug = strip_slashes(record["url_path"])
        image, present = record["content"]["hero"]["backgroundImage"], ~_missing(record["url_path"])
        bad_slug = ~_missing(slug) & ~slug.rlike(X.SLUG_PATTERN)
        label = "Hero image URL may be invalid"
    else:
        slug, image = record["slug"], record["featured_image"]
        present = ~_missing(slug)
        bad_slug = present & ~slug.rlike(X.SLUG_PATTERN)
        label = "Featured image URL may be invalid"
    bad_image = ~_missing(image) & ~is_image_url(image)
    score = F.lit(1.0) - F.when(bad_slug, 0.3).otherwise(0.0) - F.when(bad_image, 0.1).otherwise(0.0)
    details = _texts(F.when(bad_slug, "Invalid slug format").when(present, "Slug format valid"), F.when(bad_image, label))
    return _dimension(X.clamp01(score), _or_default(details, "All validation checks passed"))


def ai_ambiguity(log: Column, uses_ai: bool) -> Column:
    if not uses_ai:
        return _dimension(F.lit(1.0), F.array(F.lit("No AI rules used — deterministic processing")))

    def judge(used: Column) -> Column:
        mean = F.aggregate(used, F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size(used)
        low = F.size(F.filter(used, lambda e: e["confidence"] < 0.5))
        text = F.concat(
            F.size(used).cast("string"), F.lit(" AI transformation(s), avg confidence: "),
            F.floor(mean * 100 + 0.5).cast("string"), F.lit("%"),
        )
        details = _texts(text, F.when(low > 0, F.concat(low.cast("string"), F.lit(" low-confidence AI result(s)"))))
        return F.when(F.size(used) > 0, _dimension(X.clamp01(mean), details)).otherwise(
            _dimension(F.lit(1.0), F.array(F.lit("No AI transformations applied")))
        )

    return X.once(F.filter(log, lambda e: e["ai_used"]), judge)


def weighted_overall(scores: list[Column], weights: list[float]) -> Column:
    """Weighted sum in dimension order, half-up to two places."""
    total = F.lit(0.0)
    for s, w in zip(scores, weights):
        total = total + s * F.lit(w)
    return X.round2(total)


def score_record(record: Column, template: str, field_scores: Column, log: Column, uses_ai: bool) -> Column:
    """``struct<overall, dimensions, field_scores, flags>``; flags content first, then structural, extraction."""
    weights = WEIGHTS[uses_ai]
    dims = F.struct(
        structural(record, template, field_scores).alias("structural"),
        extraction(record, template, field_scores).alias("extraction"),
        content_quality(record, template).alias("content_quality"),
        validation(record, template).alias("validation"),
        ai_ambiguity(log, uses_ai).alias("ai_ambiguity"),
    )

    def pack(d: Column) -> Column:
        rows = [
            F.struct(F.lit(n).alias("category"), d[n]["score"].alias("score"), F.lit(w).alias("weight"), d[n]["details"].alias("details"))
            for n, w in weights.items()
        ]
        return F.struct(
            weighted_overall([d[n]["score"] for n in weights], list(weights.values())).alias("overall"),
            F.array(*rows).alias("dimensions"),
            field_scores.alias("field_scores"),
            F.concat(d["content_quality"]["flags"], d["structural"]["flags"], d["extraction"]["flags"]).alias("flags"),
        )

    return X.once(dims, pack)


def route(overall: Column, threshold: float = 0.8) -> Column:
    return F.when(overall >= threshold, "auto_approved").otherwise("needs_review")
