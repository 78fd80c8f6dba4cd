"""SEO fields and JSON-LD documents of routes.

Site settings are one row of configuration: they enter as literals (a dict), so resolving a
million routes needs no join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import text as X
from pagemill.functions.urls import cms_path, mime_from_url

IMAGE_TYPE = "struct<url:string,secureUrl:string,width:double,height:double,alt:string,type:string>"
ARTICLE_TYPES = ["Article", "BlogPosting", "NewsArticle"]
FAQ_KEYS = ["faqs", "faqItems", "faq_items", "questions"]
FAVICON_FALLBACK = "/favicon.ico"


def _clean(c: Column) -> Column:
    return X.null_if_blank(X.strip_ws(c))


def _lit(value: Any) -> Column:
    return F.lit(value if value not in ("", None) else None).cast("string")


def social_image(value: Column) -> Column:
    """Image struct from a URL text or a JSON object with details, NULL without a URL."""
    is_json = F.startswith(X.strip_ws(value), F.lit("{"))
    obj = F.from_json(F.when(is_json, value), IMAGE_TYPE)
    url = F.when(is_json, _clean(obj["url"])).otherwise(_clean(value))
    return F.when(
        url.isNotNull(),
        F.struct(
            url.alias("url"), _clean(obj["secureUrl"]).alias("secureUrl"), X.positive_or_null(obj["width"]).alias("width"),
            X.positive_or_null(obj["height"]).alias("height"), _clean(obj["alt"]).alias("alt"), _clean(obj["type"]).alias("type"),
        ),
    )


def resolve_image(route_image: Column, og_image: Column) -> Column:
    """Route image URL first; details come from the og image where there is one."""
    route, og = social_image(route_image), social_image(og_image)
    source = F.coalesce(og, route)
    url = F.coalesce(route["url"], og["url"])
    details = [source[n].alias(n) for n in ("secureUrl", "width", "height", "alt", "type")]
    return F.when(url.isNotNull(), F.struct(url.alias("url"), *details))


def resolve_seo(routes: DataFrame, settings: dict[str, Any], keep: list[str]) -> DataFrame:
    """Title, description, canonical, robots, Open Graph and Twitter fields per route.

    Routes carry ``url_path, title, route_type`` and any of the meta columns.
    """

    def col(name: str) -> Column:
        return F.col(name).cast("string") if name in routes.columns else F.lit(None).cast("string")

    site_name, site_url = _lit((settings.get("siteName") or "").strip()), _lit((settings.get("siteUrl") or "").strip())
    social_title = F.coalesce(
        *[_clean(col(n)) for n in ("og_title", "route_og_title", "meta_title", "title")], site_name
    )
    description = F.coalesce(*[_clean(col(n)) for n in ("og_description", "route_og_description", "meta_description", "description")])
    built = F.when(site_url.isNotNull() & (col("url_path") != ""), F.concat(site_url, cms_path(col("url_path"))))
    canonical = F.coalesce(_clean(col("route_canonical")), _clean(col("canonical_url")), built)
    noindex = F.coalesce(col("noindex"), F.lit("false")) == "true"
    if settings.get("siteNoindex"):
        noindex = F.lit(True)
    image = resolve_image(col("image"), col("og_image"))
    is_post = col("route_type") == "post"
    return routes.withColumn("_image", image).select(
        *keep,
        X.append_site_name(social_title, site_name).alias("seo_title"),
        description.alias("seo_description"), canonical.alias("canonical"),
        F.when(noindex, "noindex, nofollow").alias("robots"),
        social_title.alias("social_title"), F.when(is_post, "article").otherwise("website").alias("og_type"),
        F.lit("en_US").alias("og_locale"), site_name.alias("og_site_name"), F.col("_image").alias("social_image"),
        F.coalesce(_clean(col("updated_at")), _clean(col("published_at"))).alias("og_updated_time"),
        F.when(F.col("_image").isNotNull(), "summary_large_image").otherwise("summary").alias("twitter_card"),
    )


def _typed_items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _faq_pairs(items: Column) -> Column:
    """Entries with a non-empty question and answer text."""
    def text(i: Column, name: str) -> Column:
        raw = F.try_variant_get(i, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(i, f"$.{name}", "string"))

    pairs = F.transform(items, lambda i: F.struct(text(i, "question").alias("question"), text(i, "answer").alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def faq_items(content: Column) -> Column:
    """FAQ pairs of a page's JSON content.

    The enabled ``faq`` block, then the alternative keys, then the first array property whose
    entries are all FAQ pairs.
    """
    none = F.array().cast("array<struct<question:string,answer:string>>")
    v = F.try_parse_json(content)
    enabled = F.coalesce(F.try_variant_get(v, "$.faq.enabled", "boolean"), F.lit(True))

    def filled(pairs: Column) -> Column:
        return X.once(pairs, lambda p: F.when(F.size(p) > 0, p))

    sources = [F.when(enabled, filled(_faq_pairs(_typed_items(v, "$.faq.items"))))]
    sources += [filled(_faq_pairs(_typed_items(v, f"$.{k}"))) for k in FAQ_KEYS]
    props = F.from_json(content, "map<string,variant>")
    arrays = F.filter(
        F.transform(
            F.map_values(props), lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("ARRAY")), F.try_variant_get(x, "$", "array<variant>"))
        ),
        lambda a: F.size(a) > 0,
    )
    whole = F.filter(
        F.transform(arrays, lambda a: F.struct(F.size(a).alias("n"), _faq_pairs(a).alias("p"))), lambda s: s["n"] == F.size(s["p"])
    )
    return F.coalesce(*sources, F.get(whole, F.lit(0))["p"], none)


def global_schemas(raw: str | None) -> list[str]:
    """Site-wide JSON-LD objects of the settings text, as JSON texts."""
    import json

    try:
        parsed = json.loads(raw) if raw and raw.strip() else []
    except ValueError:
        return []
    items = parsed if isinstance(parsed, list) else [parsed]
    return [json.dumps(i, ensure_ascii=False, separators=(",", ":")) for i in items if isinstance(i, dict)]


def _or_null(c: Column) -> Column:
    return F.when(X.nonblank(c), c)


def postal_address(settings: dict[str, Any]) -> Column:
    line1, line2 = settings.get("addressLine1") or "", settings.get("addressLine2") or ""
    if not line1:
        return F.lit(None).cast("struct<`@type`:string,streetAddress:string,addressLocality:string,addressRegion:string,postalCode:string>")
    l2 = F.lit(line2)
    return F.struct(
        F.lit("PostalAddress").alias("@type"), F.lit(line1).alias("streetAddress"), _or_null(X.address_city(l2)).alias("addressLocality"),
        _or_null(X.address_region(l2)).alias("addressRegion"), _or_null(X.address_zip(l2)).alias("postalCode"),
    )


def json_ld(routes: DataFrame, settings: dict[str, Any], key: str) -> DataFrame:
    """``key, schema_no, schema``: JSON-LD documents of each route.

    Routes carry ``title, description, url, image, schema_type, schema_data, content,
    route_type, published_at, updated_at`` (text). ``to_json`` leaves null properties out.
    """

    def col(name: str) -> Column:
        return F.col(name).cast("string") if name in routes.columns else F.lit(None).cast("string")

    title, description, url, image = (_or_null(col(n)) for n in ("title", "description", "url", "image"))
    context = F.lit("https://schema.org").alias("@context")
    phone = _lit((settings.get("phoneDisplay") or settings.get("phoneNumber")) if settings.get("phoneNumber") else None)
    links = [l["url"] for l in settings.get("socialLinks") or [] if l.get("enabled") and l.get("url")]
    same_as = F.array(*[F.lit(u) for u in links]) if links else F.lit(None).cast("array<string>")
    site_name, site_url = settings.get("siteName") or "", settings.get("siteUrl") or ""
    name = F.lit(site_name) if site_name else title
    business = [
        name.alias("name"), url.alias("url"), description.alias("description"), image.alias("image"),
        _lit(settings.get("logoUrl")).alias("logo"), phone.alias("telephone"), postal_address(settings).alias("address"),
    ]
    page = [title.alias("name"), description.alias("description"), url.alias("url"), image.alias("image")]
    part_of = (
        F.struct(F.lit("WebSite").alias("@type"), F.lit(site_name).alias("name"), F.lit(site_url).alias("url"))
        if site_name and site_url else F.lit(None).cast("struct<`@type`:string,name:string,url:string>")
    )
    items = faq_items(col("content"))
    questions = F.transform(
        items,
        lambda i: F.struct(
            F.lit("Question").alias("@type"), X.plain_text(i["question"]).alias("name"),
            F.struct(F.lit("Answer").alias("@type"), X.plain_text(i["answer"]).alias("text")).alias("acceptedAnswer"),
        ),
    )
    faq = X.once(questions, lambda q: F.when(F.size(q) > 0, F.to_json(F.struct(context, F.lit("FAQPage").alias("@type"), q.alias("mainEntity")))))
    published, updated = _or_null(col("published_at")), _or_null(col("updated_at"))

    def article(kind: Column) -> Column:
        about = F.when(url.isNotNull(), F.struct(F.lit("WebPage").alias("@type"), url.alias("@id")))
        return F.when(
            title.isNotNull(),
            F.to_json(F.struct(
                context, kind.alias("@type"), title.alias("headline"), description.alias("description"), image.alias("image"),
                published.alias("datePublished"), F.coalesce(updated, published).alias("dateModified"),
                about.alias("mainEntityOfPage"), url.alias("url"),
            )),
        )

    def build(kind: Column) -> Column:
        return (
            F.when(kind.isin("LocalBusiness", "LegalService"), F.to_json(F.struct(context, kind.alias("@type"), *business, same_as.alias("sameAs"))))
            .when(kind == "Attorney", F.to_json(F.struct(context, kind.alias("@type"), *business)))
            .when(kind == "WebPage", F.to_json(F.struct(context, kind.alias("@type"), *page, part_of.alias("isPartOf"))))
            .when(kind == "FAQPage", F.col("_faq"))
            .when(kind.isin("AboutPage", "ContactPage"), F.to_json(F.struct(context, kind.alias("@type"), *page)))
            .when(kind.isin(ARTICLE_TYPES), article(kind))
            .otherwise(F.to_json(F.struct(context, kind.alias("@type"), title.alias("name"), url.alias("url"), description.alias("description"))))
        )

    data = col("schema_data")

    def overlay(schema: Column) -> Column:
        """Custom properties win over built ones."""
        mine = F.from_json(data, "map<string,variant>")
        base = F.from_json(schema, "map<string,variant>")
        merged = F.map_concat(F.map_filter(base, lambda k, _v: ~F.coalesce(F.map_contains_key(mine, k), F.lit(False))), mine)
        return F.when(schema.isNotNull() & (F.coalesce(F.size(mine), F.lit(0)) > 0), F.to_json(merged)).otherwise(schema)

    staged = routes.withColumn("_faq", faq).withColumn("_types", X.schema_types(col("schema_type")))
    asked = F.transform("_types", lambda t: overlay(build(t)))
    none = F.array().cast("array<string>")
    auto_faq = F.when(~F.array_contains("_types", "FAQPage") & F.col("_faq").isNotNull(), F.array("_faq")).otherwise(none)
    has_article = F.exists("_types", lambda t: t.isin(ARTICLE_TYPES))
    auto_article = F.when((col("route_type") == "post") & ~has_article, F.array(article(F.lit("Article")))).otherwise(none)
    site = [F.lit(s) for s in global_schemas(settings.get("globalSchema"))]
    everything = F.concat(asked, auto_faq, auto_article, F.array(*site) if site else none)
    present = F.filter(everything, lambda s: s.isNotNull())
    return staged.select(key, F.posexplode(present).alias("schema_no", "schema"))


def favicon_assets(a: Column) -> Column:
    """Favicon URLs with every missing size filled from the next best one; NULL without any URL."""
    def url(name: str) -> Column:
        return _clean(a[name])

    source = F.coalesce(*[url(n) for n in ("sourceUrl", "svgUrl", "icon32Url", "appleTouchIconUrl", "manifest192Url", "manifest512Url")])
    return F.when(
        source.isNotNull(),
        F.struct(
            source.alias("sourceUrl"),
            F.coalesce(_clean(a["mimeType"]), mime_from_url(source), F.lit("image/png")).alias("mimeType"),
            F.coalesce(url("icon32Url"), source).alias("icon32Url"),
            F.coalesce(url("appleTouchIconUrl"), url("icon32Url"), source).alias("appleTouchIconUrl"),
            F.coalesce(url("manifest192Url"), url("icon32Url"), source).alias("manifest192Url"),
            F.coalesce(url("manifest512Url"), url("manifest192Url"), url("icon32Url"), source).alias("manifest512Url"),
            url("svgUrl").alias("svgUrl"),
        ),
    )


def favicon_links(assets: Column, source_url: Column) -> Column:
    """``array<struct<rel, href, sizes, type>>`` without repeats; the default icon when nothing is set."""
    def row(rel: str, href: Column, sizes: str | None, kind: Column) -> Column:
        return F.when(
            href.isNotNull(),
            F.struct(F.lit(rel).alias("rel"), href.alias("href"), F.lit(sizes).cast("string").alias("sizes"), kind.alias("type")),
        )

    def build(a: Column) -> Column:
        primary = F.coalesce(a["svgUrl"], a["icon32Url"], _clean(source_url), a["sourceUrl"])
        kind = F.when(a["svgUrl"] == primary, "image/svg+xml").otherwise(F.coalesce(mime_from_url(primary), a["mimeType"], F.lit("image/png")))
        png = F.lit("image/png")
        rows = F.array(
            row("icon", primary, None, kind), row("icon", a["icon32Url"], "32x32", png),
            row("icon", a["manifest192Url"], "192x192", png), row("icon", a["manifest512Url"], "512x512", png),
            row("apple-touch-icon", a["appleTouchIconUrl"], "180x180", png),
        )
        fallback = F.array(row("icon", F.lit(FAVICON_FALLBACK), None, F.lit("image/x-icon")))
        return X.once(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.when(F.size(r) > 0, F.array_distinct(r)).otherwise(fallback))

    return X.once(favicon_assets(assets), build)
