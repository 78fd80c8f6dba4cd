"""Html work on composed pages whose right answer is plain SQL: known paragraphs in layout, known markup, known questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.catalog.import_queries import _DOC_MAPPING, _DOC_RECIPE, _PAGE_MAPPING, _PAGE_RECIPE, _fixed_options
from pagemill.catalog.registry import query
from pagemill.catalog.tables import sectioned, table
from pagemill.functions import html as H
from pagemill.operators import blocks as B, inference as N, sections as C, tokens as T
from pagemill.operators.rules import Fields, Rule, run_rule
from pagemill.plans import seo
from pagemill.plans.engine import prepare_records, run_recipe


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.regexp_replace("text", "[<>\\n]", " ").alias("text"))


_TEXT = "regexp_replace(text, '[<>\\n]', ' ', 'g')"


@query("main_content_known", f"select doc_id, '<p>' || {_TEXT} || '</p><p>' || source || '</p>' as html from documents")
def main_content_known(spark, sf):
    """Two paragraphs in one to twelve nested layout blocks, a page shell around and a side column beside them."""
    n = (F.col("doc_id") % 12 + 1).cast("int")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><script>x()</script>"), F.repeat(F.lit('<div class="et_pb_row">'), n),
        F.lit("<main><p>"), "text", F.lit("</p><p>"), "source", F.lit("</p><aside><p>side</p></aside></main>"), F.repeat(F.lit("</div>"), n), F.lit("</body></html>"),
    )
    return T.extract_main_content(_docs(spark, sf).select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", "html")


@query("main_content_columns", f"select doc_id, '<h2>' || source || '</h2><p>' || {_TEXT} || '</p>' as html from documents")
def main_content_columns(spark, sf):
    """A wide and a narrow column of a page builder, in both orders; the narrow one goes with all that is in it."""
    wide = F.concat(F.lit('<div class="et_pb_column et_pb_column_2_3"><div class="et_pb_text_inner"><h2>'), "source", F.lit("</h2><p>"), "text", F.lit("</p></div></div>"))
    narrow = F.concat(F.lit('<div class="et_pb_column et_pb_column_1_3"><div><p>'), "lang", F.lit("</p><div><p>more</p></div></div></div>"))
    both = F.when(F.col("doc_id") % 2 == 0, F.concat(wide, narrow)).otherwise(F.concat(narrow, wide))
    page = F.concat(F.lit('<div class="et_pb_section"><div class="et_pb_row"> '), both, F.lit(" </div></div>"))
    return T.extract_main_content(_docs(spark, sf).select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", "html")


@query("main_content_sidebar", f"""
    with t as (select doc_id, source, {_TEXT} as text from documents)
    select doc_id, case when length(text) + length(source) + 14 >= (length(text) + length(source) + 14 + 34 + length(source)) * 0.95
      then '<div><p>' || source || '</p></div>' else '' end || '<p>' || text || '</p><p>' || source || '</p>' as html from t""")
def main_content_sidebar(spark, sf):
    """A side bar beside the text: it goes unless that takes out less than a twentieth of the page."""
    page = F.concat(F.lit('<div class="sidebar"><p>'), "source", F.lit("</p></div><p>"), "text", F.lit("</p><p>"), "source", F.lit("</p>"))
    return T.extract_main_content(_docs(spark, sf).select("doc_id", page.alias("html")), "doc_id", "html").select("doc_id", "html")


@query("inline_markup_known", f"select doc_id, '<p>' || {_TEXT} || ' <strong>' || source || '</strong> <em>' || lang || '</em> <strong>z</strong></p>' as html from documents")
def inline_markup_known(spark, sf):
    h = F.concat(
        F.lit('<p><span class="k">'), "text", F.lit("</span> <b>"), "source", F.lit("</b> <i style='x'>"), "lang", F.lit("</i> <strong><strong>z</strong></strong><em></em></p>"))
    return _docs(spark, sf).select("doc_id", H.clean_inline_markup(h).alias("html"))


@query("faq_removed_known", f"select doc_id, 2::bigint as n_items, '<p>' || source || '</p>' as html from documents")
def faq_removed_known(spark, sf):
    h = F.concat(
        F.lit("<h2>FAQ</h2><dl><dt>What is "), "source", F.lit("?</dt><dd>"), "text", F.lit("</dd><dt>And "), "lang", F.lit("?</dt><dd>Yes, "), "lang", F.lit(".</dd></dl><p>"), "source", F.lit("</p>"))
    d = _docs(spark, sf).select("doc_id", h.alias("h")).withColumn("faq", C.detect_faq(F.col("h")))
    return d.select("doc_id", F.size("faq").cast("long").alias("n_items"), C.remove_faq(F.col("h"), F.col("faq")).alias("html"))


@query("secondary_filter_known", f"select doc_id, '<p>' || {_TEXT} || ' and these are ten more words that keep this intro in place</p>' || chr(10) || '<h2>' || source || '</h2><p>' || repeat('word ', 60) || '</p>' as html from documents")
def secondary_filter_known(spark, sf):
    """A list of recent posts between an intro and a section; only the list goes."""
    posts = '<h2>Recent Posts</h2><ul><li><a href="/a">A one</a></li><li><a href="/b">B</a></li><li><a href="/c">C</a></li></ul>'
    h = F.concat(F.lit("<p>"), "text", F.lit(" and these are ten more words that keep this intro in place</p>" + posts + "<h2>"), "source", F.lit("</h2><p>" + "word " * 60 + "</p>"))
    return _docs(spark, sf).select("doc_id", B.filter_secondary(h)["html"].alias("html"))


@query("heading_levels_known", f"""
    select doc_id, '<h1>' || source || '</h1><p>' || {_TEXT} || '</p><h2 class="k">' || lang || '</h2><h3>x</h3><h3>y</h3><h2>z</h2><h3>w</h3>' as html from documents""")
def heading_levels_known(spark, sf):
    """A second h1 and gaps between levels; a level goes where its last gap sends it."""
    h = F.concat(F.lit("<h1>"), "source", F.lit("</h1><p>"), "text", F.lit('</p><h1 class="k">'), "lang", F.lit("</h1><h4>x</h4><h5>y</h5><h2>z</h2><h5>w</h5>"))
    return _docs(spark, sf).select("doc_id", H.normalize_headings(h).alias("html"))


def _paragraphs(n):
    return [F.concat(F.lit("<p>"), "source", F.lit(f" {i} " + "word " * 58 + "</p>")) for i in range(n)]


@query("paragraph_groups_known", """
    select doc_id, n, string_agg('<p>' || source || ' ' || i || ' ' || repeat('word ', 58) || '</p>', '' order by i) as body
    from documents, (select unnest(range(10)) as i, unnest([0, 0, 0, 0, 0, 0, 0, 1, 1, 1]) as n) group by doc_id, n""")
def paragraph_groups_known(spark, sf):
    """Ten paragraphs of sixty words each, put together until a group has enough words."""
    d = _docs(spark, sf).select("doc_id", F.posexplode(C.split_by_paragraphs(F.concat(*_paragraphs(10)))).alias("n", "body"))
    return d.select("doc_id", F.col("n").alias("n"), "body")


def _run(spark, sf, kind, config, body):
    """The value of a rule over a composed body."""
    d = _docs(spark, sf).withColumn("body", body)
    got = run_rule(Rule("r", "t", kind, config), Fields({"title": F.col("source"), "body": F.col("body")})).outcome
    return d.select("doc_id", got.alias("o"))


_SECTION_TEXT = "word " * 60


@query("rule_h2_split_known", f"""
    select doc_id, '<p>' || source || '</p><h2>One ' || source || '</h2><p>{_SECTION_TEXT}</p>|<h2>Two ' || lang || '</h2><p>' || {_TEXT} || ' {_SECTION_TEXT}</p>' as bodies, 2::bigint as n from documents""")
def rule_h2_split_known(spark, sf):
    """An intro and two sections: the intro goes with the first."""
    body = F.concat(
        F.lit("<p>"), "source", F.lit("</p><h2>One "), "source", F.lit(f"</h2><p>{_SECTION_TEXT}</p><h2>Two "), "lang", F.lit("</h2><p>"), "text", F.lit(f" {_SECTION_TEXT}</p>"))
    out = _run(spark, sf, "h2_split", {"sourceField": "body"}, body)
    return out.select("doc_id", F.array_join(F.transform("o.value", lambda s: s["body"]), "|").alias("bodies"), F.size("o.value").cast("long").alias("n"))


@query("rule_faq_extract_known", f"select doc_id, 'What is ' || source || '?: <p>' || {_TEXT} || '</p>|And ' || lang || '?: <p>Yes, ' || lang || '.</p>' as pairs from documents where trim({_TEXT}) <> ''")
def rule_faq_extract_known(spark, sf):
    """Two questions in a definition list."""
    body = F.concat(
        F.lit("<h2>FAQ</h2><dl><dt>What is "), "source", F.lit("?</dt><dd><p>"), "text", F.lit("</p></dd><dt>And "), "lang", F.lit("?</dt><dd>Yes, "), "lang", F.lit(".</dd></dl>"))
    out = _run(spark, sf, "faq_extract", {"sourceField": "body"}, body)
    pairs = F.transform("o.value", lambda q: F.concat(q["question"], F.lit(": "), q["answer"]))
    kept = _docs(spark, sf).where(F.trim("text") != "").select("doc_id")
    return out.join(kept, "doc_id", "left_semi").select("doc_id", F.array_join(pairs, "|").alias("pairs"))


@query("inference_patterns_known", """
    with d as (select doc_id, source, strpos(text, chr(10)) > 0 as h2, length('<p>' || replace(text, chr(10), '</p><h2>Part</h2><p>') || '</p>') > 500 as long from documents),
    r as (select doc_id, 0 as k, 'contentSections' as target_field, 'h2_split' as rule_type, case when h2 then 'h2' else 'paragraph_groups' end as mode from d where h2 or long
      union all select doc_id, 1, 'hero', 'hero_extract', 'first_image' from d
      union all select doc_id, 2, 'meta_title', 'concat', '{{title}}| X' from d where source <> '')
    select doc_id, (row_number() over (partition by doc_id order by k) - 1)::integer as output_no, target_field, rule_type, mode, 'pattern' as inferred_from from r""")
def inference_patterns_known(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", sectioned(F.col("text")).alias("body"), F.col("source").alias("t"))
    return N.infer_from_patterns(d, "doc_id", "practice", F.col("body"), F.col("t"), F.concat("t", F.lit(" | X")), hero_image=F.lit("/x.png"))


_TYPES = ["LocalBusiness", "LegalService", "Attorney", "WebPage", "AboutPage", "ContactPage", "FAQPage", "BlogPosting"]
_NAMED = """'"name":"' || source || '","description":"' || lang || '","url":"https://e.example/' || doc_id || '"'"""


@query("json_ld_known", f"""
    select doc_id, '{{"@context":"https://schema.org","@type":"' || t || '",' || case
      when t in ('LocalBusiness', 'LegalService') then '"name":"Mill","url":"https://e.example/' || doc_id || '","description":"' || lang || '","telephone":"555 0100","sameAs":["https://s.example/m"]}}'
      when t = 'Attorney' then '"name":"Mill","url":"https://e.example/' || doc_id || '","description":"' || lang || '","telephone":"555 0100"}}'
      when t = 'WebPage' then {_NAMED} || ',"isPartOf":{{"@type":"WebSite","name":"Mill","url":"https://e.example"}}}}'
      when t in ('AboutPage', 'ContactPage') then {_NAMED} || '}}'
      when t = 'FAQPage' then '"mainEntity":[{{"@type":"Question","name":"' || source || '?","acceptedAnswer":{{"@type":"Answer","text":"' || lang || '"}}}}]}}'
      else '"headline":"' || source || '","description":"' || lang || '","datePublished":"2024-01-02","dateModified":"2024-01-02","mainEntityOfPage":{{"@type":"WebPage","@id":"https://e.example/' || doc_id || '"}},"url":"https://e.example/' || doc_id || '"}}' end as schema
    from (select *, {_TYPES}[doc_id % 8 + 1] as t from documents)""")
def json_ld_known(spark, sf):
    """One document of each type; without null or blank properties."""
    k = F.col("doc_id") % 8
    kind = F.get(F.array(*[F.lit(t) for t in _TYPES]), k.cast("int"))
    faq = F.concat(F.lit('{"faq":{"items":[{"question":"<b>'), "source", F.lit('?</b>","answer":"<p>'), "lang", F.lit('</p>"},{"question":"","answer":"x"}]}}'))
    routes = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang").alias("description"), F.concat(F.lit("https://e.example/"), "doc_id").alias("url"), F.lit(" ").alias("image"), kind.alias("schema_type"),
        F.when(k == 6, faq).alias("content"), F.lit("page").alias("route_type"), F.lit("2024-01-02").alias("published_at"))
    settings = {"siteName": "Mill", "siteUrl": "https://e.example", "phoneNumber": "5550100", "phoneDisplay": "555 0100", "socialLinks": [{"enabled": True, "url": "https://s.example/m"}, {"enabled": False, "url": "https://t.example"}]}
    return seo.json_ld(routes, settings, "doc_id").select("doc_id", "schema")


def _composed_pages(spark, sf):
    """Pages of an intro and two sections inside of layout, with a title and a path of their own."""
    body = F.concat(
        F.lit('<html><body><div class="et_pb_row"><h2>One '), "source", F.lit(f"</h2><p>{_SECTION_TEXT}</p><h2>Two "), "lang", F.lit("</h2><p>"), "text", F.lit(f" {_SECTION_TEXT}</p></div></body></html>"))
    return _docs(spark, sf).select("doc_id", F.concat("source", F.lit(" "), "doc_id").alias("title"), F.concat(F.lit("/p/x-"), "doc_id", F.lit("/")).alias("url"), body.alias("html"))


_COMPOSED = f"""select doc_id, source || ' ' || doc_id as title, '/x-' || doc_id || '/' as url_path, source || ' ' || doc_id || ' | Mill' as meta_title,
    '<h2>One ' || source || '</h2><p>{_SECTION_TEXT}</p>|<h2>Two ' || lang || '</h2><p>' || {_TEXT} || ' {_SECTION_TEXT}</p>' as bodies from documents"""


def _run_columns(out, record):
    sections = F.transform(f"{record}.content.contentSections", lambda s: s["body"])
    return out.select("doc_id", f"{record}.title", f"{record}.url_path", f"{record}.meta_title", F.array_join(sections, "|").alias("bodies"))


@query("recipe_run_pages_known", _COMPOSED)
def recipe_run_pages_known(spark, sf):
    """The whole pipeline over composed pages."""
    return _run_columns(run_recipe(_composed_pages(spark, sf), "doc_id", _PAGE_MAPPING, _PAGE_RECIPE, _fixed_options()), "record")


@query("prepared_pages_known", _COMPOSED)
def prepared_pages_known(spark, sf):
    """The automatic version of composed pages that are clean already."""
    pages = _composed_pages(spark, sf).withColumn("html", F.regexp_replace("html", r"</?(?:html|body|div)[^>]*>", ""))
    return _run_columns(prepare_records(pages, "doc_id", _PAGE_MAPPING, _fixed_options()), "auto")


@query("recipe_run_posts_known", "select doc_id, source as title, lang || '-x' || doc_id as slug, source || ' | ' || lang as meta_title from documents")
def recipe_run_posts_known(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat("lang", F.lit("-x"), "doc_id").alias("slug"), "text")
    out = run_recipe(d, "doc_id", _DOC_MAPPING, _DOC_RECIPE, _fixed_options("post"))
    return out.select("doc_id", "record.title", "record.slug", "record.meta_title")
