"""Reports, URL lists and sitemaps as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.text import escape_xml
from pagemill.functions.urls import strip_slashes
from pagemill.operators.joins import ranged

SITEMAP_URLS = 50_000
INDEX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def write_issues(issues: DataFrame, folder: str) -> None:
    issues.select("url", "type", "message").write.mode("overwrite").json(folder)


def write_urls(urls: DataFrame, folder: str) -> None:
    urls.write.mode("overwrite").text(folder)


def _entry(loc: Column, updated: Column) -> Column:
    day = F.date_format(updated, "yyyy-MM-dd")
    stamp = F.when(updated.isNotNull(), F.concat(F.lit("\n    <lastmod>"), day, F.lit("</lastmod>"))).otherwise("")
    return F.concat(F.lit("  <url>\n    <loc>"), escape_xml(loc), F.lit("</loc>"), stamp, F.lit("\n  </url>"))


def page_entries(pages: DataFrame, site_url: str) -> DataFrame:
    """``sort_key, entry`` of published, indexable pages outside the admin area."""
    origin = site_url.rstrip("/")
    path = F.when(F.col("url_path") == "/", F.lit("/")).otherwise(F.regexp_replace("url_path", r"/?\z", "/"))
    path = F.regexp_replace(path, r"//\z", "/")
    live = pages.where(
        (F.col("status") == "published") & ~F.coalesce(F.col("noindex"), F.lit(False)) & ~F.startswith("url_path", F.lit("/admin"))
    )
    return live.select(F.col("url_path").alias("sort_key"), _entry(F.concat(F.lit(origin), path), F.col("updated_at")).alias("entry"))


def post_entries(posts: DataFrame, site_url: str) -> DataFrame:
    origin = site_url.rstrip("/")
    live = posts.where((F.col("status") == "published") & ~F.coalesce(F.col("noindex"), F.lit(False)))
    loc = F.concat(F.lit(origin + "/blog/"), strip_slashes(F.col("slug")), F.lit("/"))
    return live.select(F.col("updated_at").alias("sort_key"), _entry(loc, F.col("updated_at")).alias("entry"))


def sitemap_files(entries: DataFrame, descending: bool = False, per_file: int = SITEMAP_URLS) -> DataFrame:
    """``file_no, xml``: entries in order, cut into files of at most 50 000 URLs.

    Rows are range-partitioned and numbered per partition after the counts of the partitions
    before; a file is one group of at most ``per_file`` rows.
    """
    order = F.col("sort_key").desc() if descending else F.col("sort_key").asc()
    rows = ranged(entries, order, F.col("entry"))
    counts = rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(order, "entry")))
    numbered = rows.join(offsets, "_pid").withColumn("_n", F.col("_off") + F.col("_rn") - 1)
    numbered = numbered.withColumn("file_no", F.floor(F.col("_n") / per_file))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "entry"))), lambda x: x["entry"]), "\n")
    return numbered.groupBy("file_no").agg(F.concat(F.lit(SITEMAP_HEAD + "\n"), body, F.lit("\n</urlset>")).alias("xml"))


def sitemap_name(kind: str, file_no: Column) -> Column:
    """``sitemap-pages.xml``, ``sitemap-pages-2.xml`` and so on."""
    return F.concat(F.lit(f"sitemap-{kind}"), F.when(file_no > 0, F.concat(F.lit("-"), (file_no + 1).cast("string"))).otherwise(""), F.lit(".xml"))


def sitemap_index(files: dict[str, DataFrame], site_url: str, day: str) -> DataFrame:
    """``xml``: the index document that names every file of each kind (``pages``, ``posts``).

    It has a line for each file, that is for 50 000 URLs; only the files' numbers are read.
    """
    lines = [
        files[kind].select(F.lit(i).alias("kind_no"), "file_no", sitemap_name(kind, F.col("file_no")).alias("name"))
        for i, kind in enumerate(files)
    ]
    names = lines[0]
    for more in lines[1:]:
        names = names.unionByName(more)
    loc = F.concat(escape_xml(F.lit(site_url.rstrip("/"))), F.lit("/"), F.col("name"))
    line = F.concat(F.lit("  <sitemap>\n    <loc>"), loc, F.lit(f"</loc>\n    <lastmod>{day}</lastmod>\n  </sitemap>"))
    listed = names.select("kind_no", "file_no", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("kind_no", "file_no", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    return listed.select(F.concat(F.lit(INDEX_HEAD + "\n"), body, F.lit("\n</sitemapindex>")).alias("xml"))


def write_sitemap(files: DataFrame, folder: str) -> None:
    files.select("file_no", F.col("xml").alias("value")).write.mode("overwrite").partitionBy("file_no").text(folder)
