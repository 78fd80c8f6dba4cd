"""Template field registry: the fixed target side of a mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class TemplateField:
    key: str
    label: str
    kind: str
    group: str
    required: bool = False
    cms_path: str = ""
    repeater: bool = False
    parent: str = ""


def _f(key, label, kind, group, required=False, path=None, repeater=False, parent=""):
    return TemplateField(key, label, kind, group, required, path or key, repeater, parent)


# The fields of a practice page, in order.
PRACTICE_FIELDS = [
    _f("title", "Page Title", "text", "Page Info", True),
    _f("url_slug", "URL Slug", "text", "Page Info", True),
    _f("published_at", "Publish Date", "text", "Page Info"),
    _f("meta_title", "Meta Title", "text", "SEO"),
    _f("meta_description", "Meta Description", "text", "SEO"),
    _f("canonical_url", "Canonical URL", "url", "SEO"),
    _f("og_title", "OG Title", "text", "SEO"),
    _f("og_description", "OG Description", "text", "SEO"),
    _f("og_image", "OG Image", "image", "SEO"),
    _f("noindex", "Noindex", "boolean", "SEO"),
    _f("body", "Body Content (source)", "richtext", "Source", path="_source.body"),
    _f("featured_image", "Featured Image (source)", "image", "Source", path="_source.featured_image"),
    _f("hero.sectionLabel", "Page Title / Hero H1", "text", "Hero", path="content.hero.sectionLabel"),
    _f("hero.tagline", "Hero Tagline", "text", "Hero", path="content.hero.tagline"),
    _f("hero.description", "Hero Description", "richtext", "Hero", path="content.hero.description"),
    _f("hero.backgroundImage", "Hero Background Image", "image", "Hero", path="content.hero.backgroundImage"),
    _f("hero.backgroundImageAlt", "Hero Image Alt Text", "text", "Hero", path="content.hero.backgroundImageAlt"),
    _f("contentSections", "Content Sections", "json", "Content Sections", path="content.contentSections", repeater=True),
    _f("contentSections.body", "Section Body", "richtext", "Content Sections", path="content.contentSections[].body", parent="contentSections"),
    _f("contentSections.image", "Section Image", "image", "Content Sections", path="content.contentSections[].image", parent="contentSections"),
    _f("contentSections.imageAlt", "Section Image Alt", "text", "Content Sections", path="content.contentSections[].imageAlt", parent="contentSections"),
    _f("contentSections.imagePosition", "Image Position", "select", "Content Sections", path="content.contentSections[].imagePosition", parent="contentSections"),
    _f("faq.heading", "FAQ Heading", "text", "FAQ", path="content.faq.heading"),
    _f("faq.description", "FAQ Description", "text", "FAQ", path="content.faq.description"),
    _f("faq.items", "FAQ Items", "json", "FAQ", path="content.faq.items", repeater=True),
    _f("faq.items.question", "FAQ Question", "text", "FAQ", path="content.faq.items[].question", parent="faq.items"),
    _f("faq.items.answer", "FAQ Answer", "richtext", "FAQ", path="content.faq.items[].answer", parent="faq.items"),
]
# The fields of a blog post, in order.
POST_FIELDS = [
    _f("title", "Post Title", "text", "Post Info", True),
    _f("slug", "URL Slug", "text", "Post Info", True),
    _f("excerpt", "Excerpt", "text", "Post Info"),
    _f("published_at", "Publish Date", "text", "Post Info"),
    _f("category", "Category", "text", "Post Info"),
    _f("featured_image", "Featured Image", "image", "Post Info"),
    _f("body", "Body", "richtext", "Content"),
    _f("meta_title", "Meta Title", "text", "SEO"),
    _f("meta_description", "Meta Description", "text", "SEO"),
    _f("og_image", "OG Image", "image", "SEO"),
    _f("canonical_url", "Canonical URL", "url", "SEO"),
    _f("og_title", "OG Title", "text", "SEO"),
    _f("og_description", "OG Description", "text", "SEO"),
    _f("noindex", "Noindex", "boolean", "SEO"),
]
TEMPLATES = {"practice": PRACTICE_FIELDS, "post": POST_FIELDS}

# Column-name aliases per field; a repeated alias belongs to the last field listed.
FIELD_ALIASES = {
    "title": ["title", "pagetitle", "name", "heading", "h1", "titlerendered", "title.rendered", "posttitle", "post_title", "metadata.title", "metadatatitle"],
    "url_slug": ["slug", "urlslug", "url", "path", "urlpath", "permalink", "link", "postname", "post_name"],
    "slug": ["slug", "urlslug", "postslug", "permalink", "postname", "post_name"],
    "meta_title": ["metatitle", "seotitle", "titletag"],
    "meta_description": ["metadescription", "seodescription", "metadesc", "description", "metadata.description", "metadatadescription"],
    "hero.tagline": ["tagline", "herotagline", "headline", "heroheadline"],
    "hero.description": ["herodescription", "herointro", "herobody", "intro", "introduction"],
    "hero.backgroundImage": ["heroimage", "herobackground", "backgroundimage", "heroimg", "bannerimage"],
    "hero.backgroundImageAlt": ["heroimagealt", "backgroundimagealt"],
    "body": ["body", "content", "articlecontent", "postbody", "html", "article", "contentrendered", "content.rendered", "postcontent", "post_content", "markdown"],
    "excerpt": ["excerpt", "summary", "shortdescription", "teaser", "excerptrendered", "excerpt.rendered", "postexcerpt", "post_excerpt"],
    "category": ["category", "categoryname", "cat", "topic"],
    "featured_image": ["featuredimage", "image", "thumbnail", "thumbimage", "postimage", "coverimage", "metadata.ogimage", "ogimage"],
    "faq.heading": ["faqheading", "faqtitle"],
    "faq.description": ["faqdescription", "faqintro"],
    "og_image": ["ogimage", "socialmediaimage", "shareimage"],
    "og_title": ["ogtitle", "socialtitle"],
    "og_description": ["ogdescription", "socialdescription"],
    "canonical_url": ["canonicalurl", "canonical"],
    "published_at": ["publishedat", "published_at", "publishdate", "publish_date", "published", "postdate", "post_date", "date"],
}


def alias_lookup() -> dict[str, str]:
    return {alias: key for key, aliases in FIELD_ALIASES.items() for alias in aliases}


def fields_of(template: str) -> list[TemplateField]:
    return TEMPLATES.get(template, [])


def mappable_fields(template: str) -> list[TemplateField]:
    return [f for f in fields_of(template) if not f.parent]


def repeater_children(template: str, parent: str) -> list[TemplateField]:
    return [f for f in fields_of(template) if f.parent == parent]


def required_fields(template: str) -> list[TemplateField]:
    return [f for f in fields_of(template) if f.required]


def image_fields(template: str) -> list[TemplateField]:
    return [f for f in fields_of(template) if f.kind == "image"]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table: one row per template field, with its position."""
    rows = [
        (name, i, f.key, f.label, f.cms_path, f.required, f.kind, f.group, f.repeater, f.parent)
        for name, fields in TEMPLATES.items()
        for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(
        rows,
        "template string, position int, key string, label string, cms_path string, required boolean, "
        "kind string, field_group string, repeater boolean, parent string",
    )


def grouped_fields(spark: SparkSession) -> DataFrame:
    """Field keys per template and group, in registry order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "key")))
    return registry(spark).groupBy("template", "field_group").agg(F.transform(ordered, lambda x: x["key"]).alias("keys"))
