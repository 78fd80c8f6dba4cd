"""Content documents: settings with defaults, page and post documents, route bundles."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.text import null_if_empty
from pagemill.functions.urls import cms_path, is_blog_post_path, strip_slashes
from pagemill.operators.forms import route_lookups

# Top-level keys by which a content object is recognised.
CONTENT_KEYS = {
    "home": ["hero", "about", "practiceAreasIntro", "practiceAreas", "testimonials", "blog", "results", "faq", "contact"],
    "about": ["hero", "story", "missionVision", "team", "values", "stats", "whyChooseUs", "cta"],
    "contact": ["hero", "contactMethods", "form", "officeHours", "process", "visitOffice", "cta"],
    "practice_areas": ["hero", "grid", "whyChoose", "cta"],
    "practice": ["hero", "socialProof", "contentSections", "faq"],
}
# Settings columns that fall back to blank text, and those with another default.
TEXT_SETTINGS = [
    "site_name", "logo_url", "logo_alt", "favicon_source_url", "phone_number", "phone_display", "phone_availability",
    "header_cta_text", "header_cta_url", "footer_resources_heading", "footer_practice_areas_heading", "footer_tagline_html",
    "address_line1", "address_line2", "map_embed_url", "copyright_text", "site_url", "ga4_measurement_id", "google_ads_id",
    "google_ads_conversion_label", "head_scripts", "footer_scripts", "global_schema",
]
PRIVATE_SETTINGS = ["id", "created_at", "updated_by"]
RECENT_POSTS_DEFAULT = 6
POST_COLUMNS = ["id", "title", "slug", "body", "excerpt", "featured_image", "category_id"]


def settings_with_defaults(settings: DataFrame) -> DataFrame:
    """Settings rows with every missing value replaced by its default."""
    out = []
    for c in settings.columns:
        if c in TEXT_SETTINGS:
            out.append(F.coalesce(null_if_empty(F.col(c)), F.lit("")).alias(c))
        elif c == "apply_phone_globally":
            out.append(F.coalesce(c, F.lit(True)).alias(c))
        elif c == "site_noindex":
            out.append(F.coalesce(c, F.lit(False)).alias(c))
        elif c in ("navigation_items", "social_links"):
            empty = F.array().cast(settings.schema[c].dataType)
            out.append(F.when(F.size(c) > 0, F.col(c)).otherwise(empty).alias(c))
        else:
            out.append(F.col(c))
    return settings.select(*out)


def public_settings(settings: DataFrame) -> DataFrame:
    """Column-pruned view of the settings that visitors may read."""
    return settings.select(*[c for c in settings.columns if c not in PRIVATE_SETTINGS])


def has_content_keys(content: Column, kind: str) -> Column:
    """Whether a JSON object has a known key of a content kind, even one set to null."""
    v = F.try_parse_json(content)
    keys = F.json_object_keys(F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), content))
    return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in CONTENT_KEYS[kind]])), F.lit(False))


def is_block_array(content: Column) -> Column:
    items = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")
    bad = F.filter(items, lambda i: F.schema_of_variant(F.try_variant_get(i, "$.type", "variant")).isNull()
                   | (F.schema_of_variant(F.try_variant_get(i, "$.type", "variant")) != "STRING"))
    return F.coalesce(F.size(bad) == 0, F.lit(False)) & items.isNotNull()


def page_kind(page_type: Column, content: Column) -> Column:
    practice = F.coalesce(page_type == "practice", F.lit(False)) | has_content_keys(content, "practice")
    return F.when(practice, "practice").otherwise("generic")


def merge_defaults(content: Column, defaults: dict[str, Any], ddl: str) -> Column:
    """JSON content laid over defaults leaf by leaf; an empty array gives way to the default.

    ``ddl`` is the struct type both follow.
    """
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(ddl)

    def walk(value: Column, base: Any, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StructType):
            base = base or {}
            return F.struct(*[walk(value[f.name], base.get(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        fallback = F.from_json(F.lit(json.dumps({"x": base})), T.StructType([T.StructField("x", dtype)]))["x"]
        if isinstance(dtype, T.ArrayType):
            return F.when(F.size(value) > 0, value).otherwise(fallback)
        return F.coalesce(value, fallback)

    parsed = F.from_json(content, schema)
    return F.when(F.startswith(F.trim(content), F.lit("{")), walk(parsed, defaults, schema)).otherwise(
        walk(F.lit(None).cast(schema), defaults, schema)
    )


def page_meta(df: DataFrame) -> Column:
    """Meta struct of a page or post row; missing columns are NULL."""
    def col(n: str) -> Column:
        return F.col(n).cast("string") if n in df.columns else F.lit(None).cast("string")

    names = ["meta_title", "meta_description", "canonical_url", "og_title", "og_description", "og_image", "schema_type", "schema_data"]
    noindex = F.coalesce(F.col("noindex"), F.lit(False)) if "noindex" in df.columns else F.lit(False)
    return F.struct(*[col(n).alias(n) for n in names], noindex.alias("noindex"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Published pages as documents keyed by their normalised path."""
    live = pages.where(F.col("status") == "published")
    return live.select(
        cms_path(F.col("url_path")).alias("path"),
        F.struct(
            cms_path(F.col("url_path")).alias("url_path"), F.coalesce("title", F.lit("")).alias("title"), "page_type", "content",
            page_meta(pages).alias("meta"), F.col("published_at"), F.col("updated_at"),
        ).alias("page"),
    )


def posts_with_category(posts: DataFrame, categories: DataFrame) -> DataFrame:
    """Posts with category name and slug; a post without a category stays."""
    c = categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"), F.col("slug").alias("category_slug"))
    return posts.join(c, posts["category_id"] == F.col("_cid"), "left").drop("_cid")


def assign_categories(posts: DataFrame, name: str, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts with ``category_id``, and the category table with the names that were missing.

    A name matches a category by name or slug, ignoring case and outer space; each new name is
    created once, however many posts carry it.
    """
    from pagemill.functions.text import slugify, strip_ws

    def norm(c: Column) -> Column:
        return F.lower(strip_ws(c))

    by_key = categories.select("id", F.explode(F.array_distinct(F.array(norm(F.col("name")), norm(F.col("slug"))))).alias("_key"))
    by_key = by_key.groupBy("_key").agg(F.min("id").alias("id"))
    wanted = posts.where(norm(F.col(name)) != "").groupBy(norm(F.col(name)).alias("_key")).agg(F.min(strip_ws(F.col(name))).alias("_name"))
    fresh = wanted.join(by_key, "_key", "left_anti").select(
        F.sha2("_key", 256).alias("id"), F.col("_name").alias("name"), slugify(F.col("_name")).alias("slug"), "_key"
    )
    all_keys = by_key.select("_key", "id").unionByName(fresh.select("_key", "id"))
    out = posts.withColumn("_key", norm(F.col(name))).join(all_keys.withColumnRenamed("id", "category_id"), "_key", "left").drop("_key")
    return out, categories.select("id", "name", "slug").unionByName(fresh.select("id", "name", "slug"))


def post_documents(posts: DataFrame) -> DataFrame:
    live = posts.where(F.col("status") == "published")
    extra = [c for c in ("category_name", "category_slug") if c in posts.columns]
    return live.select(
        F.concat(F.lit("/blog/"), strip_slashes(F.col("slug")), F.lit("/")).alias("path"),
        F.struct(*POST_COLUMNS, *extra, page_meta(posts).alias("meta"), "published_at", "created_at", "updated_at").alias("post"),
    )


def recent_posts(posts: DataFrame, limit: int) -> DataFrame:
    """Newest published posts; an undated post counts as newest, ties go by id."""
    live = posts.where(F.col("status") == "published")
    return live.orderBy(F.desc_nulls_first("published_at"), "id").limit(limit)


def related_posts(posts: DataFrame, limit: int = 3) -> DataFrame:
    """``id, related``: per post the newest others, from one list of limit + 1 posts."""
    top = recent_posts(posts, limit + 1).select("id", "published_at")
    packed = top.agg(
        F.array_sort(F.collect_list(F.struct(F.col("published_at").isNotNull().alias("dated"), (-F.unix_micros("published_at")).alias("age"), "id"))).alias("top")
    )
    ids = [r["id"] for r in packed.first()["top"]]
    newest = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    live = posts.where(F.col("status") == "published")
    return live.select("id", F.slice(F.filter(newest, lambda x: x != F.col("id")), 1, limit).alias("related"))


def blog_index_view(content: Column) -> Column:
    """Hero and recent-posts settings of the first block of each kind, with defaults."""
    items = F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")

    def block(kind: str) -> Column:
        return F.get(F.filter(items, lambda b: F.try_variant_get(b, "$.type", "string") == kind), F.lit(0))

    def text(b: Column, name: str) -> Column:
        return F.coalesce(null_if_empty(F.try_variant_get(b, f"$.{name}", "string")), F.lit(""))

    hero, recent = block("hero"), block("recent-posts")
    count = F.try_variant_get(recent, "$.postCount", "int")
    return F.struct(
        F.struct(
            text(hero, "sectionLabel").alias("title"), text(hero, "tagline").alias("subtitle"),
            F.try_variant_get(hero, "$.backgroundImage", "string").alias("backgroundImage"),
        ).alias("hero"),
        F.struct(
            text(recent, "sectionLabel").alias("sectionLabel"), text(recent, "heading").alias("heading"),
            F.when(count != 0, count).otherwise(F.lit(RECENT_POSTS_DEFAULT)).alias("postCount"),
        ).alias("recentPosts"),
    )


def shared_sections(pages: DataFrame) -> tuple[str | None, str | None]:
    """``whyChooseUs`` and ``cta`` of the published About page, as JSON texts; one row of control data."""
    row = pages.where((F.col("status") == "published") & (cms_path(F.col("url_path")) == "/about/")).select(
        F.to_json(F.try_variant_get(F.try_parse_json("content"), "$.whyChooseUs", "variant")).alias("why"),
        F.to_json(F.try_variant_get(F.try_parse_json("content"), "$.cta", "variant")).alias("cta"),
    ).first()
    return (row["why"], row["cta"]) if row else (None, None)


def lay_shared_sections(pages: DataFrame, shared: tuple[str | None, str | None]) -> DataFrame:
    """Contact and practice-areas pages with the About page's shared sections in place of theirs."""
    why, cta = shared
    path = cms_path(F.col("url_path"))

    def put(content: Column, names: dict[str, str | None]) -> Column:
        given = {k: v for k, v in names.items() if v is not None}
        if not given:
            return content
        over = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.parse_json(F.lit(v)))])
        base = F.map_filter(F.from_json(content, "map<string,variant>"), lambda k, _v: ~k.isin(list(given)))
        return F.to_json(F.map_concat(base, over))

    content = (
        F.when(path == "/contact/", put(F.col("content"), {"cta": cta}))
        .when(path == "/practice-areas/", put(F.col("content"), {"whyChoose": why, "cta": cta}))
        .otherwise(F.col("content"))
    )
    return pages.withColumn("content", content)


def site_paths(pages: DataFrame, posts: DataFrame) -> DataFrame:
    """Distinct published paths: pages outside the admin area, and posts under the blog."""
    p = pages.where((F.col("status") == "published") & ~F.startswith("url_path", F.lit("/admin"))).select("url_path")
    b = posts.where(F.col("status") == "published").select(F.concat(F.lit("/blog/"), F.col("slug")).alias("url_path"))
    return p.unionByName(b).distinct()


HOME_POSTS, RELATED_POSTS = 4, 3


def route_bundles(pages: DataFrame, posts: DataFrame, forms: DataFrame, settings: dict[str, Any], sidebar: DataFrame | None = None) -> DataFrame:
    """One row per route: its document, the forms it needs, the posts it lists and, for a post, the side bar.

    The home page lists four posts, a post the three newest others, the blog index as many as its view asks for. They are cut from
    one list of the newest posts, which is as long as the longest of these and joins the routes as one row. Contact and practice-areas
    pages take the About page's shared sections. ``sidebar`` (``attorney_image``, ``award_images``) has one row.
    """
    pages = lay_shared_sections(pages, shared_sections(pages))
    docs = page_documents(pages).withColumn("post", F.lit(None).cast(post_documents(posts).schema["post"].dataType))
    blog = post_documents(posts).withColumn("page", F.lit(None).cast(docs.schema["page"].dataType))
    routes = docs.select("path", "page", "post").unionByName(blog.select("path", "page", "post"))
    routes = routes.withColumn("lookups", route_lookups(F.col("path"), F.col("page.content"), F.col("post.body"), F.col("post.excerpt")))
    f = forms.select(F.col("id").alias("form_id"), F.col("name").alias("form_name"))
    wanted = routes.select("path", F.explode("lookups.ids").alias("form_id")).join(f, "form_id").select("path", "form_id").unionByName(
        routes.select("path", F.explode("lookups.names").alias("form_name")).join(f, "form_name").select("path", "form_id")
    ).groupBy("path").agg(F.sort_array(F.collect_set("form_id")).alias("form_ids"))
    is_post, on_index = is_blog_post_path(F.col("path")), F.col("path") == "/blog/"
    asked = pages.where(cms_path(F.col("url_path")) == "/blog/").select(blog_index_view(F.col("content"))["recentPosts"]["postCount"].alias("n"))
    longest = max(HOME_POSTS, asked.agg(F.max("n")).first()[0] or 0)
    # Posts as they are listed, newest first.
    top = post_documents(recent_posts(posts, longest)).select("post")
    age = F.struct(F.col("post.published_at").isNotNull().alias("dated"), (-F.unix_micros("post.published_at")).alias("age"), F.col("post.id").alias("id"), "post")
    newest = top.agg(F.transform(F.array_sort(F.collect_list(age)), lambda x: x["post"]).alias("newest")).withColumn("_one", F.lit(1))
    view = blog_index_view(F.col("page.content"))["recentPosts"]["postCount"]
    none = F.array().cast(newest.schema["newest"].dataType)
    listed = (
        F.when(F.col("path") == "/", F.slice("newest", 1, HOME_POSTS))
        .when(on_index, F.slice("newest", 1, F.greatest(F.coalesce(view, F.lit(0)), F.lit(0))))
        .when(is_post, F.slice(F.filter(F.slice("newest", 1, HOME_POSTS), lambda x: x["id"] != F.col("post.id")), 1, RELATED_POSTS))
        .otherwise(none)
    )
    kind = F.when(is_post, "post").when(on_index, "blog_index").otherwise(page_kind(F.col("page.page_type"), F.col("page.content")))
    side = F.lit(None).cast("struct<attorney_image:string,award_images:string>")
    row = sidebar.select("attorney_image", "award_images").first() if sidebar is not None else None
    if row is not None:
        side = F.when(is_post, F.struct(F.lit(row["attorney_image"]).cast("string").alias("attorney_image"), F.lit(row["award_images"]).cast("string").alias("award_images")))
    placed = routes.join(wanted, "path", "left").withColumn("_one", F.lit(1)).join(F.broadcast(newest), "_one", "left")
    placed = placed.withColumn("recent_posts", F.coalesce(listed, none))
    return placed.select(
        "path", kind.alias("kind"), "page", "post", F.coalesce("form_ids", F.array().cast("array<string>")).alias("form_ids"),
        F.transform("recent_posts", lambda x: x["id"]).alias("recent_post_ids"), "recent_posts", side.alias("sidebar"),
        F.lit(settings.get("siteName") or "").alias("site_name"),
    )


def injected_page_data(paths: DataFrame, path: str, pages: DataFrame, posts: DataFrame) -> DataFrame:
    """Title, meta and dates per path, a post document before a page document; unknown paths are left out."""
    p, b = page_documents(pages), post_documents(posts)
    joined = paths.select(cms_path(F.col(path)).alias("path")).distinct().join(p, "path", "left").join(b, "path", "left")
    has_post = F.col("post").isNotNull()
    return joined.where(has_post | F.col("page").isNotNull()).select(
        "path", F.when(has_post, F.col("post.title")).otherwise(F.col("page.title")).alias("title"),
        F.when(~has_post, F.col("page.page_type")).alias("page_type"),
        F.when(has_post, F.col("post.meta")).otherwise(F.col("page.meta")).alias("meta"),
        F.when(has_post, F.coalesce("post.published_at", "post.created_at")).otherwise(F.col("page.published_at")).alias("published_at"),
        F.when(has_post, F.col("post.updated_at")).otherwise(F.col("page.updated_at")).alias("updated_at"),
    )


def visible_rows(df: DataFrame, role: str, kind: str, admins: DataFrame | None = None, user: str | None = None) -> DataFrame:
    """Rows a role may read: published for the public, all for signed-in users, import tables for admins only.

    With ``admins`` (``user_id``) a signed-in ``user`` counts as an admin if the table names them, and is none
    otherwise. Tables without a status (templates, categories, media, forms) are open to all.
    """
    if kind == "import":
        if admins is not None:
            named = admins.where(F.col("user_id") == F.lit(user)).select(F.lit(True).alias("_named")).distinct()
            return df.withColumn("_named", F.lit(True)).join(named, "_named", "left_semi").drop("_named")
        return df if role == "admin" else df.limit(0)
    if role in ("admin", "signed_in"):
        return df
    if kind == "redirects":
        return df.where(F.coalesce(F.col("enabled"), F.lit(False)))
    return df.where(F.col("status") == "published") if "status" in df.columns else df


def newest_first(df: DataFrame, key: str, order: str, top: int) -> DataFrame:
    """Newest rows per key; Spark cuts each partition to ``top`` rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_first(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


