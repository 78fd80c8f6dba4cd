"""Loads, joins, constraints, revisions, review counts, windows and top-k over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.catalog import sql as S
from pagemill.catalog.registry import query
from pagemill.catalog.tables import table
from pagemill.functions.text import jaccard
from pagemill.operators import constraints as K
from pagemill.operators import links as L
from pagemill.operators import review as R
from pagemill.operators.forms import submission
from pagemill.operators.slugs import resolve_collisions
from pagemill.operators.validation import duplicate_groups, duplicate_issues
from pagemill.plans import content as C
from pagemill.sources import loads
from pagemill.sources.readers import content_scan
from pagemill.streaming.jobs import debounced


# --- loads -----------------------------------------------------------------------------

_BATCH = "select o_orderkey as row_index, o_custkey::varchar as slug from orders"
_TARGET = "select s_suppkey::varchar as slug from supplier"
_KNOWN = f"""
    with b as ({_BATCH}), t as ({_TARGET}),
    k as (select row_index, slug, slug in (select slug from t) as here, row_index <> min(row_index) over (partition by slug) as again from b)"""


def _batch(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_index"), F.col("o_custkey").cast("string").alias("slug"), F.col("o_orderpriority").alias("title")
    )


def _target(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("slug"), F.col("s_name").alias("title"))


def _outcome(mode: str):
    def run(spark, sf):
        return loads.load_outcomes(_target(spark, sf), _batch(spark, sf), "slug", "row_index", mode)

    return run


query("import_create", f"{_KNOWN} select row_index, slug, case when here or again then 'failed' else 'created' end as status, case when here or again then 'Already exists' end as error_message from k")(_outcome("create"))
query("import_skip", f"{_KNOWN} select row_index, slug, case when here or again then 'skipped' else 'created' end as status, null as error_message from k")(_outcome("skip_duplicates"))
query("import_upsert", f"{_KNOWN} select row_index, slug, case when here or again then 'updated' else 'created' end as status, null as error_message from k")(_outcome("upsert"))
query("import_update", f"{_KNOWN} select row_index, slug, case when here then 'updated' else 'failed' end as status, case when not here then 'Not found' end as error_message from k")(_outcome("update"))


@query("load_target", """
    select s_suppkey::varchar as slug, s_name as title from supplier where s_suppkey not in (select o_custkey from orders)
    union all select o_custkey::varchar, arg_max(o_orderpriority, o_orderkey) from orders group by o_custkey""")
def load_target(spark, sf):
    target, batch = _target(spark, sf), _batch(spark, sf)
    done = loads.load_outcomes(target, batch, "slug", "row_index", "upsert")
    return loads.load_target(target, batch, done, "slug", "row_index")


def _job_items(spark, sf):
    batch = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("job-"), "o_orderstatus").alias("job"))
    done = _outcome("upsert")(spark, sf).join(batch, F.col("row_index") == F.col("k"))
    return loads.job_items(done, F.col("job"))


_ITEMS = f"{_KNOWN}, i as (select 'job-' || o_orderstatus as job, case when here or again then 'updated' else 'created' end as status from k join orders on o_orderkey = row_index)"


@query("job_counters", f"""{_ITEMS} select job as import_job_id, count(*) filter (status = 'created') as created, count(*) filter (status = 'updated') as updated,
    0::bigint as skipped, 0::bigint as failed from i group by job""")
def job_counters(spark, sf):
    return loads.job_counters(_job_items(spark, sf))


@query("job_rows", f"""{_ITEMS} select job as id, 'post' as template_type, 'completed' as status, 'upsert' as import_mode, 'csv' as source_type, 'r1' as recipe_id, timestamp '2024-05-01' as created_at, count(*) as total_records, count(*) filter (status = 'created') as created_count,
    count(*) filter (status = 'updated') as updated_count, 0::bigint as skipped_count, 0::bigint as failed_count, '{{}}' as recipe_json from i group by job""")
def job_rows(spark, sf):
    return loads.job_row(_job_items(spark, sf), "post", mode="upsert", source_type="csv", recipe_id="r1", created_at=F.lit("2024-05-01").cast("timestamp"))


@query("jobs_with_items", """
    select o_orderkey as id, o_orderdate as created_at, l_linenumber, l_returnflag as item_status from orders left join lineitem on l_orderkey = o_orderkey""")
def jobs_with_items(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("import_job_id"), "l_linenumber", F.col("l_returnflag").alias("status"))
    return loads.jobs_with_items(jobs, items).select("id", "created_at", "l_linenumber", "item_status")


@query("recent_jobs", "select o_orderkey as id, o_orderdate as created_at from orders order by o_orderdate desc, o_orderkey limit 50")
def recent_jobs(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return loads.recent_jobs(jobs)


@query("content_scan", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 20")
def content_scan_query(spark, sf):
    o = table(spark, sf, "orders")
    return content_scan(o, F.col("o_orderstatus") == "F", ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


# --- keys and constraints ---------------------------------------------------------------

@query("duplicate_keys", """
    select row_index, 'slug' as field, 'Duplicate slug "' || k || '" found in ' || n || ' rows, first in row ' || (low + 1) as message, 'error' as severity from (
      select o_orderkey as row_index, (o_custkey % 7)::varchar as k from orders) join
      (select (o_custkey % 7)::varchar as k, min(o_orderkey) as low, count(*) as n from orders group by 1) using (k)
    where n > 1""")
def duplicate_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("string").alias("k"))
    return duplicate_issues(o, "o_orderkey", "k", "post")


@query("duplicate_groups", """select l_partkey::varchar as key, l_orderkey * 10 + l_linenumber as row_index, count(*) over w as n_rows, min(l_orderkey * 10 + l_linenumber) over w as first_row
    from lineitem window w as (partition by l_partkey) qualify n_rows > 1""")
def duplicate_groups_query(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"), F.col("l_partkey").cast("string").alias("k"))
    return duplicate_groups(l, "r", "k")


@query("existing_keys", "select distinct '/' || c_custkey || '/' as url_path from customer where '/' || c_custkey || '/' in (select '/' || s_suppkey || '/' from supplier)")
def existing_keys(spark, sf):
    path = F.concat(F.lit("/"), "c_custkey", F.lit("/"))
    c = table(spark, sf, "customer").select(path.alias("url_path"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("/"), "s_suppkey", F.lit("/")).alias("url_path"))
    return s.join(c, "url_path", "left_semi").distinct()


@query("orphan_keys", "select o_orderkey, o_custkey from orders where o_custkey not in (select s_suppkey from supplier)")
def orphan_keys(spark, sf):
    return K.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "supplier"), "s_suppkey").select("o_orderkey", "o_custkey")


@query("enum_violations", """select o_orderkey, 'o_orderpriority' as "column", o_orderpriority as value from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')""")
def enum_violations(spark, sf):
    return K.enum_violations(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("unique_violations", "select o_custkey as value, count(*) as n from orders group by 1 having count(*) > 1")
def unique_violations(spark, sf):
    return K.unique_violations(table(spark, sf, "orders"), "o_custkey")


@query("null_violations", """select o_orderkey, 'f' as "column" from orders where o_orderstatus = 'F' union all select o_orderkey, 'p' from orders where o_orderpriority = '5-LOW'""")
def null_violations(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", 1).alias("f"), F.when(F.col("o_orderpriority") != "5-LOW", 1).alias("p")
    )
    return K.null_violations(o, "o_orderkey", ["f", "p"])


@query("insert_if_absent", """select s_suppkey as k, s_name as name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)""")
def insert_if_absent(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return K.insert_if_absent(s, c, "k")


@query("cascade_delete", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def cascade_delete(spark, sf):
    c = table(spark, sf, "customer")
    gone = c.where("c_acctbal < 0").select("c_custkey")
    return K.cascade_delete(c, "c_custkey", table(spark, sf, "orders"), "o_custkey", gone)[1].select("o_orderkey", "o_custkey")


@query("set_null_on_delete", "select o_orderkey, case when o_custkey not in (select c_custkey from customer where c_acctbal < 0) then o_custkey end as o_custkey from orders")
def set_null_on_delete(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    return K.set_null_on_delete(table(spark, sf, "orders"), "o_custkey", gone, "c_custkey").select("o_orderkey", "o_custkey")


@query("update_stamps", """select p_partkey, case when p_size > 25 then timestamp '2024-06-01' else timestamp '2024-01-01' end as updated_at from part""")
def update_stamps(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    new = p.withColumn("p_name", F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))).withColumn(
        "p_size", F.when(F.col("p_size") > 25, F.col("p_size") + 1).otherwise(F.col("p_size"))
    )
    out = K.stamp_updates(p, new, "p_partkey", ["p_name", "p_size"], F.lit("2024-06-01").cast("timestamp_ntz"))
    return out.select("p_partkey", "updated_at")


@query("assign_ids", "select p_partkey, (select max(s_suppkey) from supplier) + row_number() over (order by p_partkey) as page_id from part")
def assign_ids(spark, sf):
    existing = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"))
    return K.assign_ids(existing, table(spark, sf, "part").select("p_partkey"), "page_id", "p_partkey")


@query("media_policy", """select p_partkey, 'type not allowed: ' || lower(split_part(p_type, ' ', 1)) as message from part
    union all select p_partkey, 'too large: ' || (p_size * 2000000) from part where p_size * 2000000 > 52428800""")
def media_policy(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("mime_type"), (F.col("p_size") * 2000000).alias("file_size")
    )
    return K.media_violations(p, "p_partkey")


@query("unused_media", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def unused_media(spark, sf):
    media = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/m/"), "p_partkey").alias("public_url"))
    refs = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("/m/"), "l_partkey").alias("image"))
    return L.unused_media(media, refs, "image").select("p_partkey")


@query("media_usage", "select l_orderkey, l_linenumber, p_name from lineitem left join part on p_partkey = l_partkey")
def media_usage(spark, sf):
    media = table(spark, sf, "part").select("p_name", F.concat(F.lit("/m/"), "p_partkey").alias("public_url"))
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("/m/"), "l_partkey").alias("image"))
    return L.media_usage(refs, "image", media).select("l_orderkey", "l_linenumber", "p_name")


# --- revisions, search and replace --------------------------------------------------------

@query("search_replace_audit", """
    select 'op1' as operation_id, 'documents' as table_name, doc_id as row_id, 'text' as field, text as old_value, replace(text, ' the ', ' THE ') as new_value
    from documents where contains(text, ' the ')""")
def search_replace_audit(spark, sf):
    d = table(spark, sf, "documents")
    return K.search_replace(d, "documents", "doc_id", ["text", "source"], " the ", " THE ", F.lit("op1"))


@query("search_replace_applied", "select doc_id, replace(text, ' the ', ' THE ') as text, replace(source, 'src1', 'origin-1') as source from documents")
def search_replace_applied(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    audit = K.search_replace(d, "documents", "doc_id", ["text"], " the ", " THE ", F.lit("op1")).unionByName(
        K.search_replace(d, "documents", "doc_id", ["source"], "src1", "origin-1", F.lit("op2"))
    )
    return K.apply_audit(d, audit, "doc_id", ["text", "source"])


@query("search_replace_rollback", "select doc_id, text from documents")
def search_replace_rollback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    first = K.search_replace(d, "documents", "doc_id", ["text"], " the ", " THE ", F.lit("op1"))
    after = K.apply_audit(d, first, "doc_id", ["text"])
    second = K.search_replace(after, "documents", "doc_id", ["text"], " of ", " OF ", F.lit("op2"))
    now = K.apply_audit(after, second, "doc_id", ["text"])
    audit = first.unionByName(second).withColumn("rolled_back", F.lit(False))
    return K.rollback(now, audit, "doc_id", ["text"])


@query("revision_rows", "select p_partkey, p_name, p_size, timestamp '2024-06-01' as revised_at from part where p_size > 25")
def revision_rows(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    new = p.withColumn("p_size", F.when(F.col("p_size") > 25, 0).otherwise(F.col("p_size")))
    return K.revision_rows(p, new, "p_partkey", ["p_name", "p_size"], F.lit("2024-06-01").cast("timestamp_ntz"))


@query("revision_diff", """
    select o_custkey, o_orderkey, field, old, new from (
      select o_custkey, o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) as field, unnest([lag(o_orderstatus) over w, lag(o_orderpriority) over w]) as old,
        unnest([o_orderstatus, o_orderpriority]) as new, row_number() over w as n from orders window w as (partition by o_custkey order by o_orderkey))
    where n > 1 and old is distinct from new""")
def revision_diff(spark, sf):
    return K.revision_changes(table(spark, sf, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("latest_per_id", "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_per_id(spark, sf):
    o = table(spark, sf, "orders")
    return K.latest_per_id(o, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


# --- review ------------------------------------------------------------------------------

_SCORED = """select o_orderkey, o_orderstatus, o_orderpriority, overall, case when overall >= 0.8 then 'auto_approved' else 'needs_review' end as status
    from (select *, floor(o_totalprice / 500000 * 100 + 0.5) / 100 as overall from orders)"""


def _scored(spark, sf):
    from pagemill.functions.text import round2
    from pagemill.operators.scoring import route

    o = table(spark, sf, "orders").withColumn("overall", round2(F.col("o_totalprice") / 500000))
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "overall", route(F.col("overall")).alias("status"))


@query("review_routing", f"""select o_orderkey, overall, status, case when status = 'needs_review' and overall >= 0.3 then 'approved' else status end as after_bulk,
    overall < 0.3 as is_error, overall >= 0.3 and overall < 0.8 as is_low, contains(lower(o_orderpriority), 'urgent') as found from ({_SCORED})""")
def review_routing(spark, sf):
    s, o = F.col("status"), F.col("overall")
    return _scored(spark, sf).select(
        "o_orderkey", "overall", "status", R.bulk_approve(s, o).alias("after_bulk"), R.review_filter("errors", o, F.array()).alias("is_error"),
        R.review_filter("low_confidence", o, F.array()).alias("is_low"), R.title_contains(F.col("o_orderpriority"), "Urgent").alias("found"),
    )


@query("review_decisions", f"""select o_orderkey, case o_orderstatus when 'F' then 'approved' when 'O' then 'skipped' else status end as status from ({_SCORED})""")
def review_decisions(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "approve").otherwise("skip").alias("decision")
    )
    return R.apply_decisions(_scored(spark, sf).select("o_orderkey", "status"), d, "o_orderkey")


@query("review_counts", f"""select count(*) filter (status = 'auto_approved') as auto_approved, count(*) filter (status = 'needs_review') as needs_review, 0::bigint as approved,
    0::bigint as skipped, count(*) filter (status = 'needs_review' and overall < 0.3) as errors from ({_SCORED})""")
def review_counts(spark, sf):
    return R.review_counts(_scored(spark, sf))


@query("confidence_summary", f"select round(avg(overall), 6) as avg_confidence, min(overall) as min_confidence, max(overall) as max_confidence, count(*) as n from ({_SCORED}) where status = 'auto_approved'")
def confidence_summary(spark, sf):
    c = R.confidence_summary(_scored(spark, sf))
    return c.withColumn("avg_confidence", F.round("avg_confidence", 6))


# --- content tables -----------------------------------------------------------------------

@query("category_join", "select c_custkey as id, n_name as category_name, lower(n_name) as category_slug from customer left join nation on n_nationkey = c_nationkey")
def category_join(spark, sf):
    posts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("category_id"))
    cats = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))
    return C.posts_with_category(posts, cats).select("id", "category_name", "category_slug")


@query("category_assign", f"""
    with p as (select doc_id, case when doc_id % 2 = 0 then ' EUROPE ' else source end as cat from documents)
    select doc_id, coalesce((select r_regionkey::varchar from region where lower(r_name) = lower(trim(cat))), sha256(lower(trim(cat)))) as category_id from p""")
def category_assign(spark, sf):
    posts = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, " EUROPE ").otherwise(F.col("source")).alias("cat"))
    cats = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"))
    return C.assign_categories(posts, "cat", cats)[0].select("doc_id", "category_id")


def _posts(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "draft").otherwise("published").alias("status"),
        F.col("o_orderdate").alias("published_at"),
    )


_POSTS = "select o_orderkey::varchar as id, o_orderdate as published_at from orders where o_orderstatus <> 'F'"


@query("recent_topk", f"select id, published_at from ({_POSTS}) order by published_at desc, id limit 6")
def recent_topk(spark, sf):
    return C.recent_posts(_posts(spark, sf), 6).select("id", "published_at")


@query("related_topk", f"""
    with p as ({_POSTS}), t as (select list(id order by published_at desc, id) as top from (select * from p order by published_at desc, id limit 4))
    select id, array_to_string(list_filter(top, lambda x: x <> id)[:3], ',') as related from p, t""")
def related_topk(spark, sf):
    posts = _posts(spark, sf).withColumn("published_at", F.col("published_at").cast("timestamp"))
    return C.related_posts(posts, 3).select("id", F.array_join("related", ",").alias("related"))


@query("newest_per_group", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 3")
def newest_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.struct(F.col("o_orderdate"), (-F.col("o_orderkey")).alias("k")).alias("at"))
    return C.newest_first(o, "o_custkey", "at", 3).select("o_custkey", "o_orderkey")


@query("visible_rows", "select 'public' as role, count(*) as n from orders where o_orderstatus <> 'F' union all select 'signed_in', count(*) from orders union all select 'import_public', 0 union all select 'import_named', count(*) from orders union all select 'import_other', 0 union all select 'categories_public', count(*) from nation")
def visible_rows(spark, sf):
    p = _posts(spark, sf)
    parts = [("public", C.visible_rows(p, "public", "posts")), ("signed_in", C.visible_rows(p, "signed_in", "posts")), ("import_public", C.visible_rows(p, "public", "import"))]
    admins = table(spark, sf, "supplier").select(F.col("s_name").alias("user_id"))
    named = admins.agg(F.min("user_id")).first()[0]
    parts += [("import_named", C.visible_rows(p, "signed_in", "import", admins, named)), ("import_other", C.visible_rows(p, "signed_in", "import", admins, "nobody"))]
    parts.append(("categories_public", C.visible_rows(table(spark, sf, "nation"), "public", "categories")))
    return K.union_all([d.agg(F.count("*").alias("n")).select(F.lit(r).alias("role"), "n") for r, d in parts])


@query("settings_defaults", """select c_custkey as id, case when c_acctbal < 0 then '' else c_name end as site_name, coalesce(c_acctbal > 5000, false) as site_noindex, true as apply_phone_globally from customer""")
def settings_defaults(spark, sf):
    s = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("site_name"),
        F.when(F.col("c_acctbal") > 5000, True).alias("site_noindex"), F.lit(None).cast("boolean").alias("apply_phone_globally"),
    )
    return C.settings_with_defaults(s)


@query("page_kinds", """select event_id, case when event_type in ('view', 'click') then 'practice' else 'generic' end as kind, event_type = 'click' as is_contact, event_type = 'error' as is_blocks from events""")
def page_kinds(spark, sf):
    t = F.col("event_type")
    body = (
        F.when(t == "click", F.concat(F.lit('{"hero":null,"x":'), "props", F.lit("}")))
        .when(t == "error", F.concat(F.lit('[{"type":"a","v":'), "props", F.lit("}]"))).when(t == "purchase", F.lit("[3]")).otherwise(F.col("props"))
    )
    e = table(spark, sf, "events").select("event_id", F.when(t == "view", "practice").alias("page_type"), body.alias("content"))
    return e.select(
        "event_id", C.page_kind(F.col("page_type"), F.col("content")).alias("kind"), C.has_content_keys(F.col("content"), "contact").alias("is_contact"),
        C.is_block_array(F.col("content")).alias("is_blocks"),
    )


@query("content_defaults", """select event_id, json_extract_string(props, '$.k') as title, 'Hello' as tagline, 3::bigint as n_items from events""")
def content_defaults(spark, sf):
    body = F.concat(F.lit('{"hero":{"title":"'), F.get_json_object("props", "$.k"), F.lit('"},"items":[]}'))
    merged = C.merge_defaults(
        body, {"hero": {"title": "T", "tagline": "Hello"}, "items": ["a", "b", "c"]}, "struct<hero:struct<title:string,tagline:string>,items:array<string>>"
    )
    e = table(spark, sf, "events").select("event_id", merged.alias("c"))
    return e.select("event_id", "c.hero.title", "c.hero.tagline", F.size("c.items").cast("long").alias("n_items"))


@query("blog_index_views", """select event_id, 'L' || json_extract_string(props, '$.k') as title, '' as heading, case when event_type = 'view' then 6 else 4 end::bigint as n_posts from events""")
def blog_index_views(spark, sf):
    body = F.concat(
        F.lit('[{"type":"hero","sectionLabel":"L'), F.get_json_object("props", "$.k"), F.lit('"},{"type":"recent-posts","postCount":'),
        F.when(F.col("event_type") == "view", "0").otherwise("4"), F.lit("}]"),
    )
    e = table(spark, sf, "events").select("event_id", C.blog_index_view(body).alias("v"))
    return e.select("event_id", F.col("v.hero.title").alias("title"), "v.recentPosts.heading", F.col("v.recentPosts.postCount").cast("long").alias("n_posts"))


@query("form_submissions", """select conv_id, turn, replace(text, chr(10), ', ') as message, role from conversations""")
def form_submissions(spark, sf):
    values = F.create_map(
        F.lit("message"), F.split("text", "\n"), F.lit("role"), F.array("role"), F.lit("empty"), F.array().cast("array<string>")
    )
    c = table(spark, sf, "conversations").select("conv_id", "turn", submission(values).alias("v"))
    return c.select("conv_id", "turn", F.try_element_at("v", F.lit("message")).alias("message"), F.try_element_at("v", F.lit("role")).alias("role"))


@query("route_bundles")
def route_bundles(spark, sf):
    pages, posts = _cms(spark, sf)
    forms = table(spark, sf, "documents").select(F.col("source").alias("name"), F.md5("source").alias("id")).distinct()
    return C.route_bundles(pages, posts, forms, {"siteName": "Mill"})


def _cms(spark, sf):
    none = F.lit(None).cast("string")
    p = table(spark, sf, "pages").select(
        F.col("url").alias("url_path"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), none.alias("page_type"),
        F.to_json(F.struct(F.concat(F.lit("{{form:src"), F.col("page_id") % 20, F.lit("}}")).alias("body"))).alias("content"),
        F.lit("published").alias("status"), F.lit("2024-01-01").cast("timestamp").alias("published_at"), F.lit("2024-01-02").cast("timestamp").alias("updated_at"),
    )
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), F.concat(F.lit("doc-"), "doc_id", F.lit("/")).alias("slug"),
        F.col("text").alias("body"), none.alias("excerpt"), none.alias("featured_image"), F.col("source").alias("category_id"), F.lit("published").alias("status"),
        F.timestamp_seconds(F.col("n_chars") * 1000).alias("published_at"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.lit("2024-01-02").cast("timestamp").alias("updated_at"),
    )
    return p, d


@query("injected_page_data", f"""
    select distinct path, title from (
      select '/blog/doc-' || doc_id || '/' as path, text as title from documents
      union all select {S.cms_path(S.path_of('url'))}, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) from pages)""")
def injected_page_data(spark, sf):
    pages, posts = _cms(spark, sf)
    paths = posts.select(F.concat(F.lit("/blog/"), "slug").alias("p")).unionByName(pages.select(F.col("url_path").alias("p")))
    return C.injected_page_data(paths, "p", pages, posts).select("path", "title").distinct()


# --- collisions, similarity, sessions -----------------------------------------------------

@query("slug_collisions", """
    with o as (select o_orderkey, o_custkey % 5 as g, row_number() over (partition by o_custkey % 5 order by o_orderkey) as r from orders)
    select o_orderkey, 'post-' || 'abcde'[g + 1] || case when r > 1 then '-' || (r - 1) else '' end as slug from o""")
def slug_collisions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("post-"), F.substring(F.lit("abcde"), (F.col("o_custkey") % 5 + 1).cast("int"), F.lit(1))).alias("slug"))
    return resolve_collisions(o, "o_orderkey", "slug", "post", "unique_suffix")


@query("word_similarity", f"""
    with d as (select doc_id, list_distinct({S.words('lower(text)')}) as a, list_distinct({S.words("lower(replace(text, ' the ', ' a-the '))")}) as b from documents)
    select doc_id, case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) end::double as similarity from d""")
def word_similarity(spark, sf):
    other = F.replace(F.col("text"), F.lit(" the "), F.lit(" a-the "))
    return table(spark, sf, "documents").select("doc_id", jaccard(F.col("text"), other).alias("similarity"))


@query("session_debounce", """
    with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 1800000000 then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
    select user_id, min(ts) as first_change, max(ts) + interval 30 minute as saved_at, arg_max(event_type, ts) as state, count(*) as changes from s group by user_id, n""")
def session_debounce(spark, sf):
    return debounced(table(spark, sf, "events"), "user_id", "ts", F.col("event_type"), "30 minutes")
