"""Mapping, rules, scoring, validation, inference and the import pipeline over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.catalog import sql as S
from pagemill.catalog.registry import query
from pagemill.catalog.tables import SQL_SECTIONED, sectioned, table
from pagemill.functions import text as X
from pagemill.operators import inference as N
from pagemill.operators import mapping as M
from pagemill.operators import scoring as Z
from pagemill.operators import validation as V
from pagemill.operators.rules import Fields, Recipe, Rule, run_rule
from pagemill.operators.templates import FIELD_ALIASES, mappable_fields
from pagemill.plans.engine import EngineOptions, engine_totals, prepare_records, run_recipe, transform_plain


# --- mapping -----------------------------------------------------------------------------

def _column_names(spark, sf):
    """Header-like names made of the words of all documents."""
    d = table(spark, sf, "documents")
    words = d.select(F.explode(F.array_distinct(X.words(F.lower(F.col("text"))))).alias("w")).distinct()
    aliases = F.array(*[F.lit(a) for names in FIELD_ALIASES.values() for a in names])
    pick = F.get(aliases, (F.length("w") * 7 % F.size(aliases)).cast("int"))
    return words.select(F.col("w"), F.when(F.length("w") % 3 == 0, F.concat(F.lit("post_"), "w")).when(F.length("w") % 3 == 1, pick).otherwise(F.col("w")).alias("name"))


def _names_sql() -> str:
    aliases = [a for names in FIELD_ALIASES.values() for a in names]
    return f"""select w, case when length(w) % 3 = 0 then 'post_' || w when length(w) % 3 = 1 then {aliases!r}[1 + length(w) * 7 % {len(aliases)}] else w end as name
        from (select distinct unnest(list_distinct({S.words('lower(text)')})) as w from documents)"""


def _match_sql(template: str) -> str:
    fields = mappable_fields(template)
    norm = lambda s: "".join(s.lower().replace("-", "").replace("_", "").split())
    alias = {a: k for k, names in FIELD_ALIASES.items() for a in names}
    keys = {f.key for f in fields}
    exact = " ".join(f"when n = '{norm(f.key)}' then '{f.key}'" for f in fields)
    known = " ".join(f"when n = '{a}' then '{k}'" for a, k in alias.items() if k in keys)
    partial = " ".join(f"when contains('{norm(f.key)}', n) or contains(n, '{norm(f.key)}') then '{f.key}'" for f in fields)
    return f"case {exact} {known} {partial} end"


@query("auto_map", f"""
    with c as (select name, min(w) as first_word from ({_names_sql()}) group by name),
    m as (select name as source, first_word, {_match_sql('post')} as target from (select *, regexp_replace(lower(name), '[-_{S.WS[1:-1]}]+', '', 'g') as n from c))
    select target, arg_min(source, first_word) as source from m where target is not null group by target""")
def auto_map(spark, sf):
    names = _column_names(spark, sf).groupBy("name").agg(F.min("w").alias("at"))
    return M.auto_map_table(names, "name", "at", "post")


@query("column_matches", f"""
    select name, {_match_sql('practice')} as field from (select *, regexp_replace(lower(name), '[-_{S.WS[1:-1]}]+', '', 'g') as n from (select distinct name from ({_names_sql()})))""")
def column_matches(spark, sf):
    return _column_names(spark, sf).select("name").distinct().select("name", M.match_field(F.col("name"), "practice").alias("field"))


def _score_sql(template: str) -> str:
    norm = lambda s: "".join(s.lower().replace("-", "").replace("_", "").split())
    alias = {a: k for k, names in FIELD_ALIASES.items() for a in names}
    rows = []
    for i, f in enumerate(mappable_fields(template)):
        k, l = norm(f.key), norm(f.label)
        mine = [a for a, key in alias.items() if key == f.key] or ["\x01"]
        rows.append(
            f"{{'i': {i}, 'key': '{f.key}', 'score': case when n = '{k}' or n = '{l}' then 100 when n in ({', '.join(repr(a) for a in mine)}) then 90 "
            f"when contains('{k}', n) or contains(n, '{k}') then 60 when contains('{l}', n) or contains(n, '{l}') then 50 else 0 end}}"
        )
    return f"[{', '.join(rows)}]"


@query("column_suggestions", f"""
    with n as (select name, regexp_replace(lower(name), '[-_{S.WS[1:-1]}]+', '', 'g') as n from (select distinct name from ({_names_sql()}))),
    s as (select name, unnest({_score_sql('post')}) as s from n)
    select name, string_agg(s.key || ':' || s.score, ',' order by s.score desc, s.i) as ranked from s where s.score > 0 group by name""")
def column_suggestions(spark, sf):
    ranked = M.suggestions_table(_column_names(spark, sf), "name", "post")
    shown = F.array_join(F.transform("ranked", lambda s: F.concat(s["key"], F.lit(":"), s["score"].cast("string"))), ",")
    return ranked.where(F.size("ranked") > 0).select("name", shown.alias("ranked"))


@query("unmapped_columns", f"select name from (select distinct name from ({_names_sql()})) where name not in (select distinct source from documents) and name not in (select lower(n_name) from nation)")
def unmapped_columns(spark, sf):
    names = _column_names(spark, sf).select("name").distinct()
    used = table(spark, sf, "documents").select("source").distinct().unionByName(table(spark, sf, "nation").select(F.lower("n_name").alias("source")))
    return M.coverage(names, "name", used)


_ORDER_MAPPING = M.Mapping([
    M.FieldMapping("title", "o_orderpriority", transform="slugify"), M.FieldMapping("category", "o_orderstatus", default="none"),
    M.FieldMapping("body", "o_comment", default="no text"), M.FieldMapping("featured_image", "image"),
])


@query("apply_mapping", """
    select o_orderkey, regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g') as title,
      case when o_orderstatus = 'F' then 'none' else o_orderstatus end as category, 'no text' as body, case when o_orderkey % 2 = 0 then '/i.png' end as featured_image,
      case when o_orderkey % 2 = 0 then '/i.png' end as "hero.backgroundImage" from orders""")
def apply_mapping(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "  ").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 2 == 0, "/i.png").otherwise("").alias("image"),
    )
    cols = M.mirror_images(M.mapped_columns(o, _ORDER_MAPPING))
    return o.select("o_orderkey", *[c.alias(n) for n, c in cols.items()])


@query("repeater_items", """
    select o_orderkey, case when o_orderstatus = 'F' then 1 else 2 end::bigint as n_items, case when o_orderstatus = 'F' then '' else 's:' || o_orderstatus || ';' end || 's:' || o_orderpriority || ';' as bodies from orders""")
def repeater_items(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("body_1"), F.col("o_orderpriority").alias("s2"), F.lit(" ").alias("image_3")
    )
    items = M.repeater_items(o, "practice", "contentSections", M.Mapping([M.FieldMapping("contentSections.body_2", "s2")]))
    d = o.select("o_orderkey", items.alias("i"))
    return d.select("o_orderkey", F.size("i").cast("long").alias("n_items"), F.array_join(F.transform("i", lambda x: F.concat(F.lit("s:"), x["body"], F.lit(";"))), "").alias("bodies"))


# --- rules -------------------------------------------------------------------------------

def _rule(spark, sf, kind: str, config: dict, target: str = "t"):
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("lang"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit('<h2 class="k" style="a:b">x</h2><p data-a="1"></p>'), sectioned(F.col("text")))).alias("body"),
    )
    fields = Fields({c: F.col(c) for c in ("title", "lang", "body")})
    out = d.select("doc_id", run_rule(Rule("r", target, kind, config), fields).outcome.alias("r"))
    return out.select("doc_id", F.col("r.value").cast("string").alias("value"), "r.score", "r.category")


_RULE_DOCS = f"""select doc_id, source as title, lang, case when doc_id % 5 <> 0 then '<h2 class="k" style="a:b">x</h2><p data-a="1"></p>' || {SQL_SECTIONED} end as body from documents"""


@query("rule_direct_map", f"select doc_id, body as value, case when body is null then 0.3 else 1.0 end::double as score, 'structural' as category from ({_RULE_DOCS})")
def rule_direct_map(spark, sf):
    return _rule(spark, sf, "direct_map", {"sourceField": "body"})


@query("rule_static_value", "select doc_id, 'fixed' as value, 1.0::double as score, 'structural' as category from documents")
def rule_static_value(spark, sf):
    return _rule(spark, sf, "static_value", {"value": "fixed"})


@query("rule_html_clean", f"""
    select doc_id, case when body is not null then v end as value, case when body is null then 0.2 when v <> body then 0.85 else 1.0 end::double as score,
      case when body is null then 'structural' else 'content_quality' end as category
    from (select *, {S.trim(chr(39).join(["regexp_replace(regexp_replace(regexp_replace(replace(body, ' class=" + chr(34) + "k" + chr(34) + " style=" + chr(34) + "a:b" + chr(34) + "', ''), ", "<p( data-a=" + chr(34) + "1" + chr(34) + ")?></p>", ", ", "", ", ", "g", "), ", "</?h2>", ", ", "", ", ", "g", "), ", "^$", ", ", "", ")"]))} as v from ({_RULE_DOCS}))""".replace("class=\"k\" style", "class=\"k\" style"))
def rule_html_clean(spark, sf):
    return _rule(spark, sf, "html_clean", {"sourceField": "body", "allowedTags": ["p", "br"]})


@query("rule_html_extract", f"""
    select doc_id, array_to_string(regexp_extract_all(body, '(?i)<h2>[^<]*</h2>'), '') as value,
      case when body is null then 0.2 when len(regexp_extract_all(body, '(?i)<h2>[^<]*</h2>')) > 0 then 0.8 else 0.3 end::double as score,
      case when body is null then 'structural' else 'extraction' end as category from ({_RULE_DOCS})""")
def rule_html_extract(spark, sf):
    return _rule(spark, sf, "html_extract", {"sourceField": "body", "pattern": "<h2>[^<]*</h2>"})


@query("rule_slugify", "select doc_id, '/p/' || source || '/' as value, 1.0::double as score, 'structural' as category from documents")
def rule_slugify(spark, sf):
    return _rule(spark, sf, "slugify", {"sourceField": "title", "prefix": "/p/", "suffix": "/"})


@query("rule_concat", f"select doc_id, title || ' - ' || lang || coalesce(' - ' || body, '') as value, case when body is null then 0.6 else 0.95 end::double as score, 'structural' as category from ({_RULE_DOCS})")
def rule_concat(spark, sf):
    return _rule(spark, sf, "concat", {"fields": ["title", "lang", "body"], "separator": " - "})


@query("rule_template", "select doc_id, source || ' | ' || lang as value, 0.9::double as score, 'structural' as category from documents")
def rule_template(spark, sf):
    return _rule(spark, sf, "concat", {"fields": ["title", "lang"], "template": "{{title}} | {{lang}}"})


@query("rule_regex_replace", rf"""select doc_id, regexp_replace(body, '(?i)<(/?)h2', '<\1h3', 'g') as value, case when body is null then 0.2 else 0.9 end::double as score,
    case when body is null then 'structural' else 'content_quality' end as category from ({_RULE_DOCS})""")
def rule_regex_replace(spark, sf):
    return _rule(spark, sf, "regex_replace", {"sourceField": "body", "pattern": "<(/?)h2", "replacement": "<$1h3"})


@query("rule_regex_first", rf"""select doc_id, regexp_replace(body, '<(/?)h2', '<\1h3') as value, case when body is null then 0.2 else 0.9 end::double as score,
    case when body is null then 'structural' else 'content_quality' end as category from ({_RULE_DOCS})""")
def rule_regex_first(spark, sf):
    return _rule(spark, sf, "regex_replace", {"sourceField": "body", "pattern": "<(/?)h2", "replacement": "<$1h3", "flags": ""})


@query("rule_ignore", "select doc_id, null as value, 1.0::double as score, 'structural' as category from documents")
def rule_ignore(spark, sf):
    return _rule(spark, sf, "ignore", {})


@query("rule_pending", "select doc_id, null as value, 0.5::double as score, 'ai_ambiguity' as category from documents")
def rule_pending(spark, sf):
    return _rule(spark, sf, "ai_transform", {"action": "summarize"})


@query("rule_h2_split")
def rule_h2_split(spark, sf):
    return _rule(spark, sf, "h2_split", {"sourceField": "body"})


@query("rule_faq_extract")
def rule_faq_extract(spark, sf):
    return _rule(spark, sf, "faq_extract", {"sourceField": "body"})


@query("rule_hero_extract", f"select doc_id, case when body is null then 0.2 else 0.5 end::double as score, case when body is null then 'structural' else 'extraction' end as category from ({_RULE_DOCS})")
def rule_hero_extract(spark, sf):
    return _rule(spark, sf, "hero_extract", {"sourceField": "body"}).select("doc_id", "score", "category")


# --- scoring -----------------------------------------------------------------------------

_POST_DOCS = """select doc_id, case when doc_id % 11 = 0 then 'Untitled' when doc_id % 7 = 0 then 'Tiny' else substr(replace(text, chr(10), ' '), 1, 60) end as title,
    case when doc_id % 9 = 0 then 'Bad Slug ' || doc_id else lang || '-' || doc_id end as slug, case when doc_id % 3 = 0 then substr(text, 1, 50) end as excerpt,
    case when n_chars % 5 <> 0 then '<p>' || text || '</p>' when n_chars % 10 = 0 then '<p>short [vc_row]</p>' end as body,
    case when doc_id % 4 = 0 then 'https://e.example/' || doc_id || '.png' when doc_id % 4 = 1 then 'img ' || doc_id end as featured_image from documents"""


def _post_record():
    k, n = F.col("doc_id"), F.col("n_chars")
    return F.struct(
        F.when(k % 11 == 0, "Untitled").when(k % 7 == 0, "Tiny").otherwise(F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 60)).alias("title"),
        F.when(k % 9 == 0, F.concat(F.lit("Bad Slug "), k)).otherwise(F.concat("lang", F.lit("-"), k)).alias("slug"),
        F.when(k % 3 == 0, F.substring("text", 1, 50)).alias("excerpt"),
        F.when(n % 5 != 0, F.concat(F.lit("<p>"), "text", F.lit("</p>"))).when(n % 10 == 0, "<p>short [vc_row]</p>").alias("body"),
        F.when(k % 4 == 0, F.concat(F.lit("https://e.example/"), k, F.lit(".png"))).when(k % 4 == 1, F.concat(F.lit("img "), k)).alias("featured_image"),
        F.lit("2024-01-01").alias("published_at"),
    )


_DIMENSIONS = rf"""
    select doc_id, case when title = 'Untitled' or title = '' then 0.7 else 1.0 end as structural,
      case when coalesce(length(body), 0) <= 100 then 0.8 - 0.2 else 0.8 end as extraction,
      greatest(0.0, least(1.0, 0.9 - (case when length(title) < 5 and title <> '' then 0.15 else 0.0 end) - (case when regexp_matches(coalesce(title, '') || coalesce(excerpt, '') || coalesce(body, ''), '(?i)\[(et_pb_|vc_|fusion_)') then 0.3 else 0.0 end)
        - (case when len(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(slug, '') || ' ' || coalesce(excerpt, '') || ' ' || coalesce(body, ''), '(?i)&[a-z]+;|&#\d+;')) > 50 then 0.1 else 0.0 end)
        - (case when body is not null and length({S.trim(S.strip_tags('body'))}) < 100 then 0.15 else 0.0 end))) as content_quality,
      1.0 - (case when not regexp_matches(slug, '{S.SLUG_OK}') then 0.3 else 0.0 end) - (case when featured_image is not null and not regexp_matches(featured_image, '^(/|https?://[^/])') then 0.1 else 0.0 end) as validation
    from ({_POST_DOCS})"""


@query("confidence_score", f"""
    select doc_id, {S.round2("0.0 + s * 0.3 + e * 0.25 + q * 0.25 + v * 0.15 + 1.0::double * 0.05")} as overall, round(e, 6) as extraction, round(q, 6) as content_quality, round(v, 6) as validation, round(s, 6) as structural
    from (select doc_id, structural::double as s, extraction::double as e, content_quality::double as q, validation::double as v from ({_DIMENSIONS}))""")
def confidence_score(spark, sf):
    record = _post_record()
    d = table(spark, sf, "documents").select("doc_id", record.alias("record"))
    none = F.array().cast(Z.FIELD_SCORE_TYPE)
    log = F.array().cast("array<struct<ai_used:boolean,confidence:double>>")
    d = d.select("doc_id", Z.score_record(F.col("record"), "post", none, log, False).alias("c"))
    names = ["structural", "extraction", "content_quality", "validation"]
    return d.select("doc_id", "c.overall", *[F.round(F.get("c.dimensions", F.lit(i))["score"], 6).alias(n) for i, n in enumerate(names)])


@query("score_flags", f"""
    select doc_id, array_to_string(list_filter([case when length(title) < 5 then 'short_title' end, case when regexp_matches(coalesce(body, ''), '(?i)\\[(et_pb_|vc_|fusion_)') then 'shortcode_remnants' end,
      case when body is not null and length({S.trim(S.strip_tags('body'))}) < 100 then 'short_body' end, case when title = 'Untitled' then 'missing_title' end,
      case when coalesce(length(body), 0) <= 100 then 'short_body' end], lambda f: f is not null), ',') as flags from ({_POST_DOCS})""")
def score_flags(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", _post_record().alias("record"))
    none = F.array().cast(Z.FIELD_SCORE_TYPE)
    log = F.array().cast("array<struct<ai_used:boolean,confidence:double>>")
    return d.select("doc_id", F.array_join(Z.score_record(F.col("record"), "post", none, log, False)["flags"], ",").alias("flags"))


@query("category_means", """
    select l_orderkey, l_linenumber, case when l_returnflag = 'A' then round((l_discount + l_tax) / 2, 9) else round(l_tax, 9) end as mean_a,
      case when l_returnflag = 'N' then round(l_discount, 9) end as mean_n from lineitem""")
def category_means(spark, sf):
    def score(value, category):
        return F.struct(F.lit("f").alias("field"), value.alias("score"), category.alias("category"), F.lit("").alias("reason"))

    scores = F.array(score(F.col("l_discount"), F.col("l_returnflag")), score(F.col("l_tax"), F.lit("A")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(Z.category_mean(scores, "A"), 9).alias("mean_a"), F.round(Z.category_mean(scores, "N"), 9).alias("mean_n")
    )


@query("weighted_scores", f"select o_orderkey, {S.round2('0.0 + v * 0.3 + (1 - v) * 0.25 + v * 0.25 + 0.9::double * 0.15 + 1.0::double * 0.05')} as overall from (select o_orderkey, o_totalprice / 500000 as v from orders)")
def weighted_scores(spark, sf):
    v = F.col("o_totalprice") / 500000
    parts = [v, F.lit(1) - v, v, F.lit(0.9), F.lit(1.0)]
    return table(spark, sf, "orders").select("o_orderkey", Z.weighted_overall(parts, list(Z.WEIGHTS[False].values())).alias("overall"))


# --- validation ----------------------------------------------------------------------------

_SHAPE = "must be lowercase, alphanumeric with hyphens only"
_PREPARED = f"""
    with r as (select *, case when doc_id % 6 = 0 then 'skipped' when doc_id % 6 = 1 then 'needs-review' else 'approved' end as status from ({_POST_DOCS}))
    select doc_id as row_index, 'status' as field, 'Record has not been approved yet' as message, 'warning' as severity from r where status = 'needs-review'
    union all select doc_id, 'title', 'Title is required', 'error' from r where status <> 'skipped' and (not regexp_matches(title, '{S.NOT_WS}') or title = 'Untitled')
    union all select doc_id, 'slug', 'Slug "' || {S.truncate('slug', 40)} || '" {_SHAPE}', 'error' from r where status <> 'skipped' and not regexp_matches(slug, '{S.SLUG_OK}')
    union all select doc_id, 'body', 'No body content — post will be empty', 'warning' from r where status <> 'skipped' and coalesce(body, '') = ''
    union all select doc_id, 'excerpt', 'No excerpt — it won''t appear in blog listings', 'warning' from r where status <> 'skipped' and coalesce(excerpt, '') = ''
    union all select doc_id, 'featured_image', 'Invalid featured image URL: "' || {S.truncate('featured_image', 50)} || '"', 'warning' from r where status <> 'skipped' and featured_image is not null and not regexp_matches(featured_image, '^https?://[^/]')"""


def _prepared(spark, sf):
    k = F.col("doc_id")
    status = F.when(k % 6 == 0, "skipped").when(k % 6 == 1, "needs-review").otherwise("approved")
    return table(spark, sf, "documents").select("doc_id", _post_record().alias("record"), status.alias("status"))


@query("validation_issues", _PREPARED)
def validation_issues(spark, sf):
    return V.validate_prepared(_prepared(spark, sf), "doc_id", "record", "status", "post")


@query("validation_summary", f"""
    select count(*) filter (e > 0) as error_rows, count(*) filter (e = 0) as warning_rows, sum(e)::bigint as error_issues, sum(w)::bigint as warning_issues
    from (select row_index, count(*) filter (severity = 'error') as e, count(*) filter (severity = 'warning') as w from ({_PREPARED}) group by row_index)""")
def validation_summary(spark, sf):
    return V.validation_totals(V.validate_prepared(_prepared(spark, sf), "doc_id", "record", "status", "post"))


@query("quick_issues", f"""
    select doc_id, (case when not regexp_matches(title, '{S.NOT_WS}') or title = 'Untitled' then 'title;' else '' end) || (case when not regexp_matches(slug, '{S.SLUG_OK}') then 'slug;' else '' end)
      || (case when coalesce(body, '') = '' then 'body;' else '' end) || (case when coalesce(excerpt, '') = '' then 'excerpt;' else '' end) as fields from ({_POST_DOCS})""")
def quick_issues(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", V.quick_checks(_post_record(), "post").alias("i"))
    return d.select("doc_id", F.array_join(F.transform("i", lambda x: F.concat(x["field"], F.lit(";"))), "").alias("fields"))


@query("mapped_issues", f"""
    with r as (select doc_id, text as title, text as body, case when doc_id % 9 = 0 then 'Bad Slug ' || doc_id else lang || '-' || doc_id end as slug,
        case when doc_id % 2 = 0 then '2024-05-01' else 'soon ' || doc_id end as published_at, case when doc_id % 4 = 1 then 'img ' || doc_id end as og_image from documents)
    select doc_id as row_index, 'title' as field, '"Post Title" is required' as message, 'error' as severity from r where not regexp_matches(title, '{S.NOT_WS}')
    union all select doc_id, 'published_at', 'Publish date "' || published_at || '" could not be parsed', 'error' from r where doc_id % 2 = 1
    union all select doc_id, 'slug', 'Slug "' || {S.truncate('slug', 40)} || '" {_SHAPE}', 'error' from r where not regexp_matches(slug, '{S.SLUG_OK}')
    union all select doc_id, 'body', 'No body content — post will be empty', 'warning' from r where not regexp_matches(body, '{S.NOT_WS}')
    union all select doc_id, 'excerpt', 'No excerpt — it won''t appear in blog listings', 'warning' from r
    union all select doc_id, 'og_image', '"OG Image" has an invalid URL: "' || og_image || '"', 'error' from r where og_image is not null""")
def mapped_issues(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("title"), F.col("text").alias("body"), F.when(k % 9 == 0, F.concat(F.lit("Bad Slug "), k)).otherwise(F.concat("lang", F.lit("-"), k)).alias("slug"),
        F.when(k % 2 == 0, "2024-05-01").otherwise(F.concat(F.lit("soon "), k)).alias("published_at"), F.when(k % 4 == 1, F.concat(F.lit("img "), k)).alias("og_image"),
    )
    return V.validate_mapped(d, "doc_id", "post")


@query("scored_issues", """
    select o_orderkey as row_index, 'title' as field, 'Title is required' as message, 'error' as severity from orders where o_orderstatus = 'P'
    union all select o_orderkey, 'confidence', 'Low confidence score (' || floor(v * 100 + 0.5)::bigint || '%)', 'warning' from (select o_orderkey, floor(o_totalprice / 500000 * 100 + 0.5) / 100 as v from orders) where v < 0.5
    union all select o_orderkey, 'quality', 'short title', 'warning' from orders where o_orderstatus = 'F'""")
def scored_issues(spark, sf):
    o = table(spark, sf, "orders")
    record = F.struct(F.when(F.col("o_orderstatus") != "P", F.lit("A title")).alias("title"), F.concat(F.lit("s-"), "o_orderkey").alias("slug"))
    conf = F.struct(
        X.round2(F.col("o_totalprice") / 500000).alias("overall"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("short_title"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
    return V.validate_scored(o.select("o_orderkey", record.alias("r"), conf.alias("c")), "o_orderkey", "r", "c", "post")


# --- inference -----------------------------------------------------------------------------

def _samples(spark, sf):
    d = table(spark, sf, "documents")
    html = F.concat(F.lit('<div class="x">'), sectioned(F.col("text")), F.lit("</div>"))
    mapped = d.select("doc_id", F.concat(F.lit("Case "), "source", F.lit(" "), "lang").alias("title"), F.concat("source", F.lit("-name")).alias("author"), html.alias("body"))
    k = F.col("doc_id") % 6
    output = mapped.select(
        "doc_id", F.col("title").alias("title"), F.when(k == 0, F.lit("fixed-value")).otherwise(X.slugify(F.col("title"))).alias("slug"),
        F.concat(F.lit("/"), X.slugify(F.col("title")), F.lit("/")).alias("url_path"), F.concat("title", F.lit(" by "), "author").alias("og_title"),
        F.concat("title", F.lit(" | X")).alias("meta_title"),
    )
    m = N.unpivot(mapped, "doc_id", ["title", "author", "body"], "mapped")
    o = N.unpivot(output, "doc_id", ["title", "slug", "url_path", "og_title", "meta_title"], "output")
    return m, o, output


@query("inference_diff", """
    select doc_id, field as target_field, kind as rule_type, src as sources, pre as prefix from (
      select doc_id, unnest(['title', 'slug', 'url_path', 'og_title', 'meta_title']) as field,
        unnest(['direct_map', case when doc_id % 6 = 0 then 'static_value' else 'slugify' end, 'slugify', 'concat', 'ambiguous']) as kind,
        unnest(['title', case when doc_id % 6 = 0 then '' else 'title' end, 'title', 'title,author', '']) as src, unnest(['', '', '/', '', '']) as pre from documents)""")
def inference_diff(spark, sf):
    m, o, _ = _samples(spark, sf)
    d = N.infer_from_diff(m, o, "doc_id")
    return d.select("doc_id", "target_field", "rule_type", F.array_join("source_fields", ",").alias("sources"), "prefix")


@query("inference_merged", """
    select doc_id, field as target_field, kind as rule_type, tier as inferred_from, 'rule_' || (row_number() over (partition by doc_id order by n)) as rule_id from (
      select doc_id, unnest([1, 2, 3, 4, 5]) as n, unnest(['title', 'slug', 'url_path', 'og_title', 'meta_title']) as field,
        unnest(['direct_map', case when doc_id % 6 = 0 then 'static_value' else 'slugify' end, 'slugify', 'concat', 'concat']) as kind, unnest(['diff', 'diff', 'diff', 'diff', 'pattern']) as tier from documents)""")
def inference_merged(spark, sf):
    return _merged(spark, sf)[0]


def _merged(spark, sf):
    m, o, output = _samples(spark, sf)
    diff = N.infer_from_diff(m, o, "doc_id")
    patterns = N.infer_from_patterns(output, "doc_id", "post", F.lit(""), F.col("title"), F.col("meta_title"))
    return N.merge_tiers(diff, patterns, "doc_id")


@query("inference_confidence", "select doc_id, 0.96::double as confidence, 5::bigint as n_rules from documents")
def inference_confidence(spark, sf):
    return N.inference_confidence(_merged(spark, sf)[0], "doc_id")


@query("inference_majority", """select * from (values ('title', 'direct_map', 'title'), ('slug', 'slugify', 'title'), ('url_path', 'slugify', 'title'), ('og_title', 'concat', 'title,author')) v(target_field, rule_type, sources)""")
def inference_majority(spark, sf):
    m, o, _ = _samples(spark, sf)
    r = N.majority_rules(N.infer_from_diff(m, o, "doc_id"))
    return r.select("target_field", "rule_type", F.array_join("source_fields", ",").alias("sources"))


@query("inference_patterns")
def inference_patterns(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", sectioned(F.col("text")).alias("body"), F.col("source").alias("t"))
    return N.infer_from_patterns(d, "doc_id", "practice", F.col("body"), F.col("t"), F.concat("t", F.lit(" | X")), hero_image=F.lit("/x.png"))


# --- pipeline ------------------------------------------------------------------------------

_PAGE_MAPPING = M.Mapping([M.FieldMapping("title", "title"), M.FieldMapping("url_slug", "url"), M.FieldMapping("body", "html")])
_PAGE_RECIPE = Recipe([
    Rule("r1", "title", "direct_map"), Rule("r2", "contentSections", "h2_split", {"sourceField": "body"}),
    Rule("r3", "meta_title", "concat", {"fields": ["title"], "template": "{{title}} | Mill"}),
])


def _source_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), "url", "html")


def _fixed_options(template: str = "practice", mode: str = "unique_suffix") -> EngineOptions:
    from datetime import datetime, timezone

    return EngineOptions(template, "Mill", None, mode, imported_at=datetime(2024, 1, 1, tzinfo=timezone.utc))


@query("recipe_run_pages")
def recipe_run_pages(spark, sf):
    out = run_recipe(_source_pages(spark, sf), "page_id", _PAGE_MAPPING, _PAGE_RECIPE, _fixed_options())
    return out.select(
        "page_id", "record.title", "record.url_path", "record.meta_title", F.size("record.content.contentSections").alias("n_sections"),
        "confidence.overall", "status", F.array_join("confidence.flags", ",").alias("flags"),
    )


_DOC_MAPPING = M.Mapping([
    M.FieldMapping("title", "source"), M.FieldMapping("slug", "slug"), M.FieldMapping("body", "text"), M.FieldMapping("category", "lang"),
])
_DOC_RECIPE = Recipe([Rule("r1", "title", "direct_map"), Rule("r2", "meta_title", "concat", {"fields": ["title", "category"], "separator": " | "})], template="post")


def _source_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat("lang", F.lit("-"), F.col("doc_id") % 200).alias("slug"), "text")


@query("recipe_run_posts")
def recipe_run_posts(spark, sf):
    out = run_recipe(_source_docs(spark, sf), "doc_id", _DOC_MAPPING, _DOC_RECIPE, _fixed_options("post"))
    return out.select("doc_id", "record.title", "record.slug", "record.meta_title", "confidence.overall", "status")


@query("recipe_totals")
def recipe_totals(spark, sf):
    return engine_totals(run_recipe(_source_docs(spark, sf), "doc_id", _DOC_MAPPING, _DOC_RECIPE, _fixed_options("post", "skip")), "doc_id")


@query("prepared_pages")
def prepared_pages(spark, sf):
    out = prepare_records(_source_pages(spark, sf), "page_id", _PAGE_MAPPING, _fixed_options())
    return out.select("page_id", "status", "auto.title", "auto.url_path", F.size("auto.content.contentSections").alias("n_sections"), F.size("issues").alias("n_issues"))


@query("prepared_posts", f"""
    select doc_id, 'needs-review' as status, source as title, lang || '-' || doc_id % 200 as slug, source as meta_title, lang as category, {S.ensure_html("text")} as body, '2024-01-01T00:00:00.000Z' as published_at from documents""")
def prepared_posts(spark, sf):
    out = prepare_records(_source_docs(spark, sf), "doc_id", _DOC_MAPPING, _fixed_options("post"))
    return out.select("doc_id", "status", "auto.title", "auto.slug", "auto.meta_title", "auto.category", "auto.body", "auto.published_at")


@query("transformed_posts", "select doc_id, source as title, lang || '-' || doc_id % 200 as slug, text as body, null as og_image from documents")
def transformed_posts(spark, sf):
    out = transform_plain(_source_docs(spark, sf), "doc_id", _DOC_MAPPING, _fixed_options("post"))
    return out.select("doc_id", "record.title", "record.slug", "record.body", "record.og_image")
