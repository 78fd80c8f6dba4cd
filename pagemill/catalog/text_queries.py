"""Text, URL, date and phone functions over documents, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.catalog import sql as S
from pagemill.catalog.registry import query
from pagemill.catalog.tables import table
from pagemill.functions import html as H
from pagemill.functions import phones as P
from pagemill.functions import text as X
from pagemill.functions import urls as U
from pagemill.functions.dates import display_date, publish_date_or, iso_utc
from pagemill.operators.cleaning import is_content_value
from pagemill.sources.readers import flatten, json_items, value_at


def _docs(spark, sf, **cols):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("normalize_whitespace", rf"""
    select doc_id, {S.trim(rf"regexp_replace(regexp_replace(regexp_replace(replace(text, ' ', '  '), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\t\x0B\f\r \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} as text
    from documents""")
def normalize_whitespace(spark, sf):
    return _docs(spark, sf, text=X.normalize_whitespace(F.replace(F.col("text"), F.lit(" "), F.lit("  "))))


@query("ensure_html", f"select doc_id, {S.ensure_html('t')} as html from (select doc_id, replace(text, '. ', chr(10) || ' ' || chr(10)) as t from documents)")
def ensure_html(spark, sf):
    d = _docs(spark, sf, t=F.replace(F.col("text"), F.lit(". "), F.lit("\n \n")))
    return d.select("doc_id", X.ensure_html(F.col("t")).alias("html"))


@query("excerpt", f"""
    select doc_id, case when length(t) > 110 then rtrim(substr(t, 1, 107)) || '...' else t end as excerpt
    from (select doc_id, {S.plain("'<p>' || text || '</p>'")} as t from documents)""")
def excerpt(spark, sf):
    body = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    return _docs(spark, sf, excerpt=X.excerpt(F.lit(None).cast("string"), body))


@query("slugify", f"select doc_id, {S.slug('text')} as slug, regexp_matches({S.slug('text')}, '{S.SLUG_OK}') as valid from documents")
def slugify(spark, sf):
    d = _docs(spark, sf, slug=X.slugify(F.col("text")))
    return d.select("doc_id", "slug", F.col("slug").rlike(X.SLUG_PATTERN).alias("valid"))


@query("truncate", f"select doc_id, {S.truncate('text', 60)} as short from documents")
def truncate(spark, sf):
    return _docs(spark, sf, short=X.truncate(F.col("text"), 60))


@query("fingerprint", f"select doc_id, {S.fingerprint('text')} as print from documents")
def fingerprint(spark, sf):
    return _docs(spark, sf, print=X.fingerprint(F.col("text")))


@query("word_counts", f"""select page_id, {S.n_words(S.plain("html"))} as n_words, len(regexp_extract_all(html, '<[^>]+>')) as n_tags from pages""")
def word_counts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", X.word_count(X.plain_text(F.col("html"))).cast("long").alias("n_words"), X.tag_count(F.col("html")).cast("long").alias("n_tags")
    )


@query("plain_text", f"select page_id, {S.plain(S.shell('html'))} as text from pages")
def plain_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", X.plain_text(H.strip_page_shell(F.col("html"))).alias("text"))


@query("strip_shortcodes", r"""
    select doc_id, regexp_replace(regexp_replace(t,
      '(?i)\[/?(?:et_pb_|vc_)[^\]]*\]|\[(?:fusion_builder_container|fusion_builder_row|fusion_builder_column|av_section|av_one_full|av_one_half|av_one_third|av_two_third|av_textblock|av_toggle_container|av_toggle|fl_builder_insert_layout|cs_section|cs_row|cs_column|cs_text|wpforms|contact-form-7|gravityform)[^\]]*\]|\[/(?:fusion_builder_container|fusion_builder_row|fusion_builder_column|av_section|av_one_full|av_one_half|av_one_third|av_two_third|av_textblock|av_toggle_container|av_toggle|fl_builder_insert_layout|cs_section|cs_row|cs_column|cs_text|wpforms|contact-form-7|gravityform)\]|\[/?(?:row|column|section|container|wrapper|spacer|divider|separator|clear)\b[^\]]*\]', '', 'g'),
      '(?i)\s*data-elementor-[a-z-]*="[^"]*"|\s*data-(?:widget|element)_type="[^"]*"|\s*data-settings=''[^'']*''', '', 'g') as text
    from (select doc_id, '[vc_row id="' || source || '"]<p data-elementor-type="x">' || replace(text, chr(10), '[/row][et_pb_text]') || '</p>[/vc_row][gallery]' as t from documents)""")
def strip_shortcodes(spark, sf):
    t = F.concat(
        F.lit('[vc_row id="'), F.col("source"), F.lit('"]<p data-elementor-type="x">'),
        F.replace(F.col("text"), F.lit("\n"), F.lit("[/row][et_pb_text]")), F.lit("</p>[/vc_row][gallery]"),
    )
    return _docs(spark, sf, text=X.strip_shortcodes(t))


def _decoded(x: str) -> str:
    for bad, good in X.NAMED_ENTITIES + X.MOJIBAKE:
        x = f"replace({x}, '{bad}', '{good}')"
    return x


@query("fix_encoding", f"select page_id, {_decoded('html')} as html from pages")
def fix_encoding(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", X.fix_encoding(F.col("html")).alias("html"))


@query("content_flags", r"""
    select page_id, regexp_matches(html, '(?i)\[(et_pb_|vc_|fusion_|av_|cs_|fl_builder)') as has_shortcodes,
      regexp_matches(html, '\x{00C3}[\x{0080}-\x{00BF}]|\x{00C2}[\x{00A0}-\x{00BF}]|\x{00E2}\x{0080}[\x{0090}-\x{009F}]') as has_mojibake,
      length(url) > 500 and regexp_matches(url, '(?is)<[a-z].*>') as url_is_content, true as html_is_content,
      contains(lower(html), 'lorem ipsum') as has_placeholder
    from pages""")
def content_flags(spark, sf):
    p, h = table(spark, sf, "pages"), F.col("html")
    return p.select(
        "page_id", h.rlike(X.SHORTCODE_HINT).alias("has_shortcodes"), h.rlike(X.MOJIBAKE_HINT).alias("has_mojibake"),
        is_content_value("url", F.col("url")).alias("url_is_content"), is_content_value("html", h).alias("html_is_content"),
        X.has_placeholder(h).alias("has_placeholder"),
    )


@query("html_transform", f"""
    select doc_id, case when regexp_matches(text, '(?is)<[a-z].*>') then text else
      array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\\n{S.WS}*\\n'), lambda p: {S.trim('p')}), lambda p: p <> ''),
        lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '') end as html
    from documents""")
def html_transform(spark, sf):
    return _docs(spark, sf, html=X.html_transform(F.col("text")))


@query("markdown_to_html", rf"""
    with s as (select doc_id, '## ' || replace(text, chr(10), chr(10) || '- **' || source || '** _x_ [l](http://u) ' ) as t from documents),
    a as (select doc_id, regexp_replace(t, '(?m)^### (.+)$', '<h3>\1</h3>', 'g') as t from s),
    b as (select doc_id, regexp_replace(t, '(?m)^## (.+)$', '<h2>\1</h2>', 'g') as t from a),
    c as (select doc_id, regexp_replace(t, '(?m)^# (.+)$', '<h1>\1</h1>', 'g') as t from b),
    d as (select doc_id, regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '__(.+?)__', '<strong>\1</strong>', 'g') as t from c),
    e as (select doc_id, regexp_replace(regexp_replace(t, '\*(.+?)\*', '<em>\1</em>', 'g'), '_(.+?)_', '<em>\1</em>', 'g') as t from d),
    f as (select doc_id, regexp_replace(t, '\[([^\]]+)\]\(([^)]+)\)', '<a href="\2">\1</a>', 'g') as t from e),
    g as (select doc_id, regexp_replace(t, '(?m)^[*-] (.+)$', '<li>\1</li>', 'g') as t from f),
    h as (select doc_id, regexp_replace(regexp_replace(t, '(?s)(<li>.*?</li>)', '<ul>\1</ul>', 'g'), '</ul>{S.WS}*<ul>', '', 'g') as t from g),
    i as (select doc_id, regexp_replace(t, '(?m)^\d+\. (.+)$', '<li>\1</li>', 'g') as t from h)
    select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.trim('x')}), lambda x: x <> ''),
      lambda x: case when regexp_matches(x, '^<(h[1-6]|ul|ol|li|p|div|blockquote)') then x else '<p>' || x || '</p>' end), '') as html
    from i""")
def markdown_to_html(spark, sf):
    t = F.concat(
        F.lit("## "),
        F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n- **"), F.col("source"), F.lit("** _x_ [l](http://u) "))),
    )
    d = _docs(spark, sf, t=t)
    return d.select("doc_id", X.markdown_to_html(F.col("t")).alias("html"))


@query("escape_xml", """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as xml from pages""")
def escape_xml(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.escape_xml(F.col("html")).alias("xml"))


@query("strip_h1", f"select page_id, {S.trim(chr(39).join(['regexp_replace(html, ', '(?is)<h1[^>]*>.*?</h1>', ', ', '', ', ', 'g', ')']))} as html from pages")
def strip_h1(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.strip_h1(F.col("html")).alias("html"))


@query("first_paragraph", rf"""
    select page_id, case when regexp_matches(html, '(?is)<p[^>]*>.*?</p>') then '<p>' || regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1) || '</p>'
        when length(t) > 200 then '<p>' || substr(t, 1, 200) || '…</p>' when t <> '' then '<p>' || t || '</p>' else '' end as intro,
      regexp_extract(html, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1) as image
    from (select page_id, html, {S.trim(S.strip_tags('html'))} as t
          from (select page_id, replace(html, '<article>', '<article><img src="/img/' || page_id || '.png" alt="a">') as html from pages))""")
def first_paragraph(spark, sf):
    img = F.concat(F.lit('<article><img src="/img/'), F.col("page_id"), F.lit('.png" alt="a">'))
    p = table(spark, sf, "pages").select("page_id", F.replace(F.col("html"), F.lit("<article>"), img).alias("html"))
    return p.select("page_id", H.first_paragraph(F.col("html")).alias("intro"), H.first_image(F.col("html")).alias("image"))


@query("url_path", f"select page_id, {S.path_of('url')} as path, {S.cms_path(S.path_of('url'))} as cms_path from pages")
def url_path(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", U.url_path_of(F.col("url")).alias("path"), U.cms_path(F.col("url")).alias("cms_path"))


@query("import_slug", f"""
    with s as (select page_id, {S.path_of("u")} as p, url from (select page_id, url, replace(url, '/en/', '/practice-areas/') as u from pages)),
    t as (select page_id, url, regexp_extract(p, '/practice-areas/([^/?#]+)', 1) as nested, regexp_replace(p, '^/+|/+$', '', 'g') as bare from s)
    select page_id, case when nested <> '' then nested
        when contains(bare, '/') then list_filter(string_split(bare, '/'), lambda x: x <> '')[-1]
        when bare <> '' then bare else {S.slug('url')} end as slug
    from t""")
def import_slug(spark, sf):
    u = F.replace(F.col("url"), F.lit("/en/"), F.lit("/practice-areas/"))
    return table(spark, sf, "pages").select("page_id", U.import_slug(u, F.col("url")).alias("slug"))


@query("trailing_slash", r"""
    select page_id, (case when length(p) > 1 and not ends_with(p, '/') then p || '/' else p end) || regexp_extract(u, '(?s)[?#].*$') as url
    from (select page_id, u, regexp_replace(regexp_extract(u, '^[^?#]*'), '/{2,}', '/', 'g') as p
          from (select page_id, replace(regexp_replace(url, '^https?://[^/]*', ''), '/', '//') as u from pages))""")
def trailing_slash(spark, sf):
    u = F.replace(F.regexp_replace("url", "^https?://[^/]*", ""), F.lit("/"), F.lit("//"))
    return table(spark, sf, "pages").select("page_id", U.enforce_trailing_slash(u).alias("url"))


_HREFS = r"""case page_id % 6 when 0 then url when 1 then regexp_replace(url, '^https?:', '') when 2 then regexp_replace(url, '^https?://[^/]*', '')
    when 3 then regexp_replace(url, '^https?://', '') when 4 then 'mailto:a' || page_id || '@example.com' else ' ../page ' || page_id end"""


def _hrefs():
    u, k = F.col("url"), F.col("page_id") % 6
    return (
        F.when(k == 0, u).when(k == 1, F.regexp_replace(u, "^https?:", "")).when(k == 2, F.regexp_replace(u, "^https?://[^/]*", ""))
        .when(k == 3, F.regexp_replace(u, "^https?://", "")).when(k == 4, F.concat(F.lit("mailto:a"), F.col("page_id"), F.lit("@example.com")))
        .otherwise(F.concat(F.lit(" ../page "), F.col("page_id")))
    )


@query("link_href", rf"""
    select page_id, case when t = '' then '' when regexp_matches(t, '(?i)^https?://') then t when starts_with(t, '//') then 'https:' || t
      when regexp_matches(t, '(?i)^(/|mailto:|tel:|#|\?)') then t
      when regexp_matches(t, '(?i)^(?:www\.)?[^/\s]+\.[^/\s]+(?:/.*)?$') then 'https://' || t
      else '/' || regexp_replace(t, '^[./]+', '') end as href
    from (select page_id, {S.trim(_HREFS)} as t from pages)""")
def link_href(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.link_href(_hrefs()).alias("href"))


@query("absolute_url", f"""
    select page_id, case when regexp_matches(t, '(?i)^(?:https?://|data:|mailto:|tel:|#|javascript:)') or t = '' then t
      when starts_with(t, '//') then 'https:' || t when starts_with(t, '/') then 'https://site.example' || t
      else 'https://site.example/' || t end as url
    from (select page_id, {S.trim(_HREFS)} as t from pages)""")
def absolute_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.resolve_url(_hrefs(), "https://site.example").alias("url"))


@query("url_checks", rf"""
    select page_id, regexp_matches(t, '(?i)^https?://[^/]') as is_http, starts_with(h, '/') or regexp_matches(t, '(?i)^https?://[^/]') as is_image,
      case when starts_with(t, '/') then t when regexp_matches(t, '(?i)^https?://[^/]') then t end as redirect
    from (select page_id, h, {S.trim('h')} as t from (select page_id, {_HREFS} as h from pages))""")
def url_checks(spark, sf):
    p = table(spark, sf, "pages").select("page_id", _hrefs().alias("h"))
    return p.select(
        "page_id", U.is_http_url(F.col("h")).alias("is_http"), U.is_image_url(F.col("h")).alias("is_image"), U.redirect_target(F.col("h")).alias("redirect")
    )


@query("path_kinds", f"""
    select page_id, regexp_matches(c, '^/blog/[^/]+/$') as is_post, regexp_matches(c, '^/practice-areas/[^/]+/$') as is_practice,
      regexp_replace(c, '^/+|/+$', '', 'g') as slug
    from (select page_id, {S.cms_path('p')} as c from (select page_id, replace(replace({S.path_of('url')}, '/en/', '/blog/'), '/de/', '/practice-areas/') as p from pages))""")
def path_kinds(spark, sf):
    path = F.replace(F.replace(U.url_path_of(F.col("url")), F.lit("/en/"), F.lit("/blog/")), F.lit("/de/"), F.lit("/practice-areas/"))
    p = table(spark, sf, "pages").select("page_id", path.alias("p"))
    return p.select(
        "page_id", U.is_blog_post_path(F.col("p")).alias("is_post"), U.is_practice_detail_path(F.col("p")).alias("is_practice"),
        U.strip_slashes(U.cms_path(F.col("p"))).alias("slug"),
    )


@query("url_params", r"""
    with u as (select page_id, url, case when contains(url, '?') then regexp_replace(url, '#.*$', '') || '&' else regexp_replace(url, '#.*$', '') || '?' end
        || 'utm_source=news%20letter&utm_medium=e-mail&gclid=' || page_id as cur from pages)
    select page_id, url_decode(regexp_extract(cur, '[?&]utm_source=([^&#]*)', 1)) as utm_source, regexp_extract(cur, '[?&]utm_medium=([^&#]*)', 1) as utm_medium,
      '' as utm_campaign, '' as utm_term, '' as utm_content, cast(page_id as varchar) as gclid, '' as fbclid, '' as msclkid, '' as gbraid, '' as wbraid,
      case when page_id % 2 = 0 then url else cur end as landing_page, cur as submission_page, '' as referrer
    from u""")
def url_params(spark, sf):
    from pagemill.plans.tracking import tracking_payload

    bare = F.regexp_replace("url", "#.*$", "")
    cur = F.concat(
        bare, F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=news%20letter&utm_medium=e-mail&gclid="), F.col("page_id")
    )
    p = table(spark, sf, "pages").select("page_id", cur.alias("cur"), F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("land"))
    return p.select("page_id", *tracking_payload(F.col("cur"), F.col("land"), F.lit(None).cast("string")))


@query("mime_types", r"""
    select page_id, case when regexp_matches(p, '\.svg$') then 'image/svg+xml' when regexp_matches(p, '\.png$') then 'image/png'
      when regexp_matches(p, '\.jpe?g$') then 'image/jpeg' when regexp_matches(p, '\.webp$') then 'image/webp' when regexp_matches(p, '\.ico$') then 'image/x-icon' end as mime
    from (select page_id, lower(regexp_replace(regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')) as p
          from (select page_id, replace(replace(url, '.html', '.PNG'), '/en/', '/x.svg?') as u from pages))""")
def mime_types(spark, sf):
    u = F.replace(F.replace(F.col("url"), F.lit(".html"), F.lit(".PNG")), F.lit("/en/"), F.lit("/x.svg?"))
    return table(spark, sf, "pages").select("page_id", U.mime_from_url(u).alias("mime"))


@query("publish_dates", """
    select o_orderkey, strftime(case o_orderkey % 4 when 3 then timestamp '2020-01-01' when 2 then date_trunc('day', o_orderdate) else o_orderdate end, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as published_at,
      case when o_orderkey % 4 = 3 then 'fallback' else 'mapped' end as publish_date_source, strftime(o_orderdate, '%B %-d, %Y') as shown
    from orders""")
def publish_dates(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    raw = (
        F.when(k == 0, F.unix_millis(d).cast("string")).when(k == 1, F.unix_seconds(d).cast("string"))
        .when(k == 2, F.date_format(d, "MMMM d, yyyy")).otherwise("soon")
    )
    # Older dates have fewer epoch digits than the rule accepts; ISO text carries those.
    raw = F.when((k == 0) & (F.length(raw) != 13) | (k == 1) & (F.length(raw) < 10), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(raw)
    o = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"), d.alias("d"))
    o = o.select("o_orderkey", "d", publish_date_or(F.col("raw"), F.lit("2020-01-01").cast("timestamp")).alias("p"))
    return o.select(
        "o_orderkey", iso_utc(F.col("p.published_at")).alias("published_at"), "p.publish_date_source",
        display_date(F.col("d"), F.col("d")).alias("shown"),
    )


_PHONE = r"(?:\+?1[\s.-]*)?(?:\(\d{3}\)|\d{3})[\s.-]*\d{3}[\s.-]*\d{4}\b"


@query("phone_numbers", rf"""
    with f as (select doc_id, unnest(list_transform(regexp_extract_all(text, '{_PHONE}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))) as d from documents),
    n as (select doc_id, case when length(d) = 11 and starts_with(d, '1') then substr(d, 2) else d end as digits from f)
    select doc_id, digits, count(*) as n, any_value(case when length(digits) = 10 then substr(digits, 1, 3) || '-' || substr(digits, 4, 3) || '-' || substr(digits, 7) else digits end) as shown,
      any_value(case when length(digits) = 10 then '(' || substr(digits, 1, 3) || ') ' || substr(digits, 4, 3) || '-' || substr(digits, 7) else digits end) as second_form
    from n where length(digits) >= 10 group by doc_id, digits""")
def phone_numbers(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(P.sync_phones(F.col("text"))).alias("digits"))
    d = d.groupBy("doc_id", "digits").agg(F.count("*").alias("n"))
    forms = P.format_variants(F.col("digits"))
    return d.select(
        "doc_id", "digits", "n", P.primary_format(F.col("digits")).alias("shown"),
        F.coalesce(F.get(forms, F.lit(1)), F.col("digits")).alias("second_form"),
    )


@query("audit_phones", r"""
    select doc_id, regexp_replace(x, '[^0-9]', '', 'g') as digits, count(*) as n
    from (select doc_id, unnest(regexp_extract_all(' ' || text, '[^/\d](\+?\d[\d\s().-]{7,}\d)', 1)) as x from documents)
    group by 1, 2""")
def audit_phones(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(P.audit_phones(F.col("text"))).alias("x"))
    return d.groupBy("doc_id", P.digits_only(F.col("x")).alias("digits")).agg(F.count("*").alias("n"))


@query("site_name_title", """
    select n_nationkey, case when n_name is null or n_name = '' then 'GERMANY' when lower(n_name) = 'germany' or ends_with(lower(n_name), '| germany') or ends_with(lower(n_name), '- germany') then n_name
      else n_name || ' | GERMANY' end as title
    from (select n_nationkey, case when n_regionkey = 3 then n_name || ' - Germany' else n_name end as n_name from nation)""")
def site_name_title(spark, sf):
    n = table(spark, sf, "nation").select(
        "n_nationkey", F.when(F.col("n_regionkey") == 3, F.concat("n_name", F.lit(" - Germany"))).otherwise(F.col("n_name")).alias("t")
    )
    return n.select("n_nationkey", X.append_site_name(F.col("t"), F.lit("GERMANY")).alias("title"))


@query("schema_type_lists", """
    select p_partkey, array_to_string(list_filter(list_transform(string_split(case when p_partkey % 2 = 0 then replace(p_type, ' ', ' , ') else
        array_to_string(string_split(p_type, ' '), ',') end, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as types
    from part""")
def schema_type_lists(spark, sf):
    even = F.replace(F.col("p_type"), F.lit(" "), F.lit(" , "))
    listed = F.to_json(F.split("p_type", " "))
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, even).otherwise(listed).alias("t"))
    return p.select("p_partkey", F.array_join(X.schema_types(F.col("t")), "|").alias("types"))


@query("address_parts", """
    select c_custkey, c_mktsegment as city, 'TX' as region, lpad(cast(c_custkey % 100000 as varchar), 5, '0') as zip from customer""")
def address_parts(spark, sf):
    line = F.concat("c_mktsegment", F.lit(", TX "), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"))
    c = table(spark, sf, "customer").select("c_custkey", line.alias("l"))
    return c.select(
        "c_custkey", X.address_city(F.col("l")).alias("city"), X.address_region(F.col("l")).alias("region"), X.address_zip(F.col("l")).alias("zip")
    )


@query("first_filled", """
    select o_orderkey, coalesce(nullif(case when o_orderstatus = 'F' then '' else o_orderstatus end, ''), o_orderpriority) as value,
      case when v >= 0.8 then 'high' when v >= 0.5 then 'medium' else 'low' end as level, greatest(0.0, least(1.0, v * 2 - 0.5)) as clamped,
      case when v - 0.5 > 0 then v - 0.5 end as positive
    from (select *, o_totalprice / 500000 as v from orders)""")
def first_filled(spark, sf):
    v = F.col("o_totalprice") / 500000
    return table(spark, sf, "orders").select(
        "o_orderkey",
        X.first_filled(F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")).alias("value"),
        X.confidence_level(v).alias("level"), X.clamp01(v * 2 - 0.5).alias("clamped"), X.positive_or_null(v - 0.5).alias("positive"),
    )


@query("template_fill", """select c_custkey, c_name || ' in ' || c_mktsegment || ' {{none}}' as text from customer""")
def template_fill(spark, sf):
    fields = {"name": F.col("c_name"), "seg": F.col("c_mktsegment")}
    return table(spark, sf, "customer").select("c_custkey", X.fill_template("{{name}} in {{seg}} {{none}}", fields).alias("text"))


@query("json_values", """select event_id, json_extract_string(props, '$.k') as k, json_extract_string('{"a":[' || props || ']}', '$.a[0].k') as nested from events""")
def json_values(spark, sf):
    wrapped = F.concat(F.lit('{"a":['), F.col("props"), F.lit("]}"))
    return table(spark, sf, "events").select(
        "event_id", value_at(F.col("props"), "k").alias("k"), value_at(wrapped, "a.0.k").alias("nested")
    )


@query("json_items", """select event_id, cast(0 as integer) as pos, json_extract_string(props, '$.k') as k from events""")
def json_items_query(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"data":{"rows":['), F.col("props"), F.lit(",3]}}")).alias("doc"))
    items, _ = json_items(e, "doc", "data.rows", ["event_id"])
    return items.select("event_id", "pos", value_at(F.col("item"), "k").alias("k"))


@query("flatten_columns", """select event_id, event_type as "meta.kind", value as "meta.inner.value", json_extract_string(props, '$.k')::bigint as "props.k" from events""")
def flatten_columns(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind"), F.struct("value").alias("inner")).alias("meta"),
        F.from_json("props", "k bigint").alias("props"),
    )
    return flatten(e)


@query("text_segments", """
    select doc_id, i as pos, case when i % 2 = 0 then 'html' else 'form' end as kind, s as value
    from (select doc_id, unnest(range(0, len(p))) as i, unnest(p) as s from (
      select doc_id, list_filter(flatten(list_transform(string_split(text, chr(10)), lambda x: [x, source])), lambda x: true)[:-2] as p from documents))
    where s <> ''""")
def text_segments(spark, sf):
    t = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("{{form:"), F.col("source"), F.lit("}}")))
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(H.form_segments(t)).alias("pos", "s"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "s.kind", "s.value")
