"""Options, registries and stored recipes over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagemill.catalog import sql as S
from pagemill.catalog.page_queries import ORIGIN
from pagemill.catalog.registry import query
from pagemill.catalog.tables import table
from pagemill.operators import blocks as B, mapping as M, templates as T
from pagemill.operators.rules import Recipe, Rule, RuleResult, outcome, register_rule
from pagemill.plans import content as C
from pagemill.plans.engine import EngineOptions, apply_rules, run_recipe
from pagemill.session import shared_folder
from pagemill.sources import sinks, stores


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_REGISTRY = f"""(values {_values((n, i, f.key, f.group, f.required, f.parent) for n, fields in T.TEMPLATES.items() for i, f in enumerate(fields))}) as r(template, position, key, field_group, required, parent)"""
_TEMPLATE_OF = "case when doc_id % 2 = 0 then 'post' else 'practice' end"


@query("template_groups", f"""
    select doc_id, field_group, string_agg(key, ',' order by position) as keys from documents join {_REGISTRY} on template = {_TEMPLATE_OF} group by doc_id, field_group""")
def template_groups(spark, sf):
    """Field groups of the template of each document, in the order of the registry."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "post").otherwise("practice").alias("template"))
    grouped = T.grouped_fields(spark)
    return d.join(F.broadcast(grouped), "template").select("doc_id", "field_group", F.array_join("keys", ",").alias("keys"))


@query("template_fields", f"""
    select doc_id, count(*) filter (parent = '') as mappable, count(*) filter (required) as required, count(*) filter (parent <> '') as children
    from documents join {_REGISTRY} on template = {_TEMPLATE_OF} group by doc_id""")
def template_fields(spark, sf):
    """Lookups in the template of each document: fields that map, that must, and that stand in a repeater."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("post"))

    def size(of) -> F.Column:
        return F.when(F.col("post"), F.lit(len(of("post")))).otherwise(F.lit(len(of("practice")))).cast("long")

    children = lambda t: [f for p in T.mappable_fields(t) for f in T.repeater_children(t, p.key)]
    return d.select("doc_id", size(T.mappable_fields).alias("mappable"), size(T.required_fields).alias("required"), size(children).alias("children"))


@query("shared_sections_laid", """
    with about as (select 'c' || c_custkey || ' ' || c_name as cta, 'why ' || c_mktsegment as why from customer where c_custkey = (select min(c_custkey) from customer))
    select doc_id, text as hero, case when doc_id % 3 = 1 then why when doc_id % 3 = 2 then 'own' else 'own' end as why,
      case when doc_id % 3 in (0, 1) then about.cta else 'own ' || source end as cta from documents, about""")
def shared_sections_laid(spark, sf):
    """The About page's shared sections over those of contact and practice-areas pages; other pages keep theirs."""
    first = table(spark, sf, "customer").agg(F.min_by(F.struct("c_custkey", "c_name", "c_mktsegment"), "c_custkey").alias("c")).select("c.*")
    about = first.select(
        F.lit("/about/").alias("url_path"), F.lit("published").alias("status"),
        F.to_json(F.struct(F.concat(F.lit("why "), "c_mktsegment").alias("whyChooseUs"), F.concat(F.lit("c"), "c_custkey", F.lit(" "), "c_name").alias("cta"))).alias("content"))
    k = F.col("doc_id") % 3
    path = F.when(k == 0, "/contact").when(k == 1, "/practice-areas/").otherwise(F.concat(F.lit("/p/"), "doc_id"))
    own = F.to_json(F.struct(F.col("text").alias("hero"), F.lit("own").alias("whyChoose"), F.concat(F.lit("own "), "source").alias("cta")))
    pages = table(spark, sf, "documents").select("doc_id", path.alias("url_path"), own.alias("content"))
    laid = C.lay_shared_sections(pages, C.shared_sections(about))
    return laid.select("doc_id", *[F.get_json_object("content", f"$.{n}").alias(a) for n, a in (("hero", "hero"), ("whyChoose", "why"), ("cta", "cta"))])


def _options_html():
    """An intro, a block under a heading of its own kind, a block with a mark, and a section that stays."""
    intro = F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>\\n]", " "), F.lit(" and these are ten more words that keep this intro in place</p>"))
    offer = F.concat(F.lit("<h2>Special offers of "), "lang", F.lit("</h2><p>" + "cheap " * 20 + "</p>"))
    marked = F.concat(F.lit("<h2>"), "source", F.lit('</h2><p data-widget="x">' + "widget " * 20 + "</p>"))
    return intro, offer, marked, F.concat(F.lit("<h2>Stays "), "lang", F.lit("</h2><p>" + "word " * 60 + "</p>"))


_INTRO = "'<p>' || regexp_replace(text, '[<>\n]', ' ', 'g') || ' and these are ten more words that keep this intro in place</p>' || chr(10)"
_STAYS = "'<h2>Stays ' || lang || '</h2><p>' || repeat('word ', 60) || '</p>'"


@query("secondary_extra_headings", f"""select doc_id, {_INTRO} || '<h2>' || source || '</h2><p data-widget="x">' || repeat('widget ', 20) || '</p>' || chr(10) || {_STAYS} as html from documents""")
def secondary_extra_headings(spark, sf):
    """A heading pattern of the caller's marks a block."""
    options = B.FilterOptions("post", extra_headings=[r"(?i)^special offers"])
    html = F.concat(*_options_html())
    return table(spark, sf, "documents").select("doc_id", B.filter_secondary(html, options)["html"].alias("html"))


@query("secondary_detectors", f"""select doc_id, {_INTRO} || '<h2>Special offers of ' || lang || '</h2><p>' || repeat('cheap ', 20) || '</p>' || chr(10) || {_STAYS} as html, 'widget' as reason from documents""")
def secondary_detectors(spark, sf):
    """A detector of the caller's marks a block by its markup."""
    options = B.FilterOptions("post", detectors=[lambda heading, html: F.when(F.contains(html, F.lit("data-widget")), F.lit("widget"))])
    found = B.filter_secondary(F.concat(*_options_html()), options)
    return table(spark, sf, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.html", F.get("f.removed", 0)["reason"].alias("reason"))


@query("rule_registered", "select doc_id, upper(source) || '!' as value, 0.7::double as score from documents")
def rule_registered(spark, sf):
    """A rule type that the caller registers by name."""
    from pagemill.operators.rules import Fields, run_rule

    register_rule("shouted_source", lambda fields, config, target: RuleResult(
        outcome(F.concat(F.upper(fields.text(config["sourceField"])), F.lit(config["sign"])), 0.7, "structural", "Shouted")))
    rule = Rule("r", "title", "shouted_source", {"sourceField": "source", "sign": "!"})
    got = run_rule(rule, Fields({"source": F.col("source")})).outcome
    return table(spark, sf, "documents").select("doc_id", got.alias("o")).select("doc_id", "o.value", "o.score")


@query("stored_recipe_run", f"""
    select doc_id, case when regexp_matches(text, '{S.NOT_WS}') then text end as title, 'p-' || {S.slug("source || ' ' || doc_id")} as slug, source || ' / ' || lang as og_title, 'draft' as kind from documents""")
def stored_recipe_run(spark, sf):
    """A recipe is stored, listed, read back and run."""
    rules = [
        Rule("1", "title", "direct_map", {"sourceField": "text"}), Rule("2", "slug", "slugify", {"sourceField": "name", "prefix": "p-"}),
        Rule("3", "og_title", "concat", {"fields": ["source", "lang"], "separator": " / "}), Rule("4", "kind", "static_value", {"value": "draft"}),
    ]
    store = stores.RecipeStore(spark, f"{shared_folder(spark)}/recipes-{uuid.uuid4().hex}")
    store.create(spark.createDataFrame([("r1", "posts", "post", Recipe(rules, name="posts").to_json())], "id string, name string, template_type string, rules_json string"))
    recipe = Recipe.from_json(store.list("post").first()["rules_json"])
    d = table(spark, sf, "documents").select("doc_id", F.struct("text", "source", "lang", F.concat("source", F.lit(" "), "doc_id").alias("name")).alias("mapped"))
    return apply_rules(d, recipe).select("doc_id", *[F.col(f"out.{n}").alias(n) for n in ("title", "slug", "og_title", "kind")])


@query("quarantined_rows", """
    select doc_id, case when doc_id % 7 = 0 then 0.0::double end as overall, doc_id % 7 = 0 as failed, source as title,
      case when doc_id % 7 = 0 then 'Processing error: "n-' || doc_id || '" is no number' end as error from documents""")
def quarantined_rows(spark, sf):
    """A rule that cannot run on some rows: these become empty records with the error, the others go through."""
    register_rule("whole_number", lambda fields, config, target: RuleResult(
        outcome(fields.text(config["sourceField"]).try_cast("long").cast("string"), 1.0, "structural", "Number"),
        error=F.when(fields.text(config["sourceField"]).try_cast("long").isNull(), F.concat(F.lit('"'), fields.text(config["sourceField"]), F.lit('" is no number')))))
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat("lang", F.lit("-x"), k).alias("slug"), "text", F.when(k % 7 == 0, F.concat(F.lit("n-"), k)).otherwise(k.cast("string")).alias("number"))
    mapping = M.Mapping([M.FieldMapping(t, c) for t, c in (("title", "source"), ("slug", "slug"), ("body", "text"), ("category", "number"))])
    recipe = Recipe([Rule("r1", "title", "direct_map"), Rule("r2", "category", "whole_number", {"sourceField": "category"})], template="post")
    out = run_recipe(d, "doc_id", mapping, recipe, EngineOptions("post", "Mill", None, "skip"))
    failed = F.array_contains("confidence.flags", "processing_error")
    return out.select(
        "doc_id", F.when(failed, F.col("confidence.overall")).alias("overall"), failed.alias("failed"), "record.title", F.when(failed, F.col("log")[0]["description"]).alias("error"))


@query("sitemap_posts", f"""
    select '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg(entry, chr(10) order by ts desc, entry) || chr(10) || '</urlset>' as xml
    from (select ts, '  <url>' || chr(10) || '    <loc>{ORIGIN}/blog/o-' || o_orderkey || '&amp;x/</loc>' || chr(10) || '    <lastmod>' || strftime(ts, '%Y-%m-%d') || '</lastmod>' || chr(10) || '  </url>' as entry, o_orderkey
      from (select o_orderkey, o_orderdate::timestamp as ts from orders where o_orderstatus = 'F' and o_orderkey % 5 <> 0)) group by floor(o_orderkey / 1e15)""")
def sitemap_posts(spark, sf):
    """Published, indexable posts, newest first, in one file of up to 50 000."""
    o = table(spark, sf, "orders")
    posts = o.select(
        F.concat(F.lit("/o-"), "o_orderkey", F.lit("&x/")).alias("slug"), F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("status"),
        (F.col("o_orderkey") % 5 == 0).alias("noindex"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return sinks.sitemap_files(sinks.post_entries(posts, ORIGIN), descending=True).select("xml")


_NEWEST = "select doc_id, text, row_number() over (order by n_chars * 1000 + doc_id desc) as r from documents"


@query("route_lists", f"""
    with n as ({_NEWEST}),
    routes as (select '/' as path, 'home' as route, null as doc_id, 4 as k union all select '/blog/', 'index', null, 7
      union all select '/blog/doc-' || doc_id || '/', 'post', doc_id, 3 from documents union all select '/contact/', 'contact', null, 0),
    l as (select path, n.doc_id, n.r, row_number() over (partition by path order by n.r) as q, k, n.text from routes join n on (route <> 'post' or n.r <= 4) and (routes.doc_id is null or routes.doc_id <> n.doc_id))
    select path, string_agg(doc_id::varchar, ',' order by q) as listed, sum(length(text))::bigint as chars, case when starts_with(path, '/blog/doc') then 'a.png' end as sidebar,
      null::varchar as cta from l where q <= k group by path
    union all select '/contact/', '', 0, null, 'c' || min(c_custkey) from customer""")
def route_lists(spark, sf):
    """Posts that each route lists, as many as it asks for; the side bar of posts; the shared section of a contact page."""
    none = F.lit(None).cast("string")
    first = table(spark, sf, "customer").agg(F.min("c_custkey").alias("c"))
    contents = {"/": F.lit("{}"), "/blog/": F.lit('[{"type":"hero"},{"type":"recent-posts","postCount":7}]'), "/contact/": F.lit('{"cta":"own"}'), "/about/": F.to_json(F.struct(F.concat(F.lit("c"), "c").alias("cta")))}
    at = F.lit("2024-01-01").cast("timestamp")
    pages = None
    for path, content in contents.items():
        page = first.select(F.lit(path).alias("url_path"), F.lit("t").alias("title"), none.alias("page_type"), content.alias("content"), F.lit("published").alias("status"), at.alias("published_at"), at.alias("updated_at"))
        pages = page if pages is None else pages.unionByName(page)
    posts = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.concat(F.lit("doc-"), "doc_id").alias("slug"), F.col("text").alias("body"), none.alias("excerpt"),
        none.alias("featured_image"), F.col("source").alias("category_id"), F.lit("published").alias("status"), F.timestamp_seconds(F.col("n_chars") * 1000 + F.col("doc_id")).alias("published_at"),
        at.alias("created_at"), at.alias("updated_at"))
    forms = table(spark, sf, "documents").select(F.col("source").alias("name"), F.md5("source").alias("id")).distinct()
    sidebar = first.select(F.lit("a.png").alias("attorney_image"), F.lit("[]").alias("award_images"))
    out = C.route_bundles(pages, posts, forms, {"siteName": "Mill"}, sidebar)
    return out.where("path <> '/about/'").select(
        "path", F.array_join("recent_post_ids", ",").alias("listed"), F.aggregate("recent_posts", F.lit(0).cast("long"), lambda a, x: a + F.length(x["body"])).alias("chars"),
        "sidebar.attorney_image", F.get_json_object("page.content", "$.cta").alias("cta")).withColumnRenamed("attorney_image", "sidebar").withColumn("cta", F.when(F.col("path") == "/contact/", F.col("cta")))
