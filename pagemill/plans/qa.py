"""Site audit: a crawl table ``(url, status, html)`` to issue rows ``url, type, message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import text as X
from pagemill.functions.html import strip_page_shell
from pagemill.functions.phones import audit_phones, digits_only
from pagemill.operators.links import broken_links, checked_links

MEANINGFUL_CHARS = 30
# What separates words for the spelling check.
WORD_BREAK = f"[{X.WS_CHARS}.,!?;:()\\[\\]{{}}\"'`\\-–—/\\\\|@#$%^&*+=<>~]+"


def _tag_attr(html: Column, tag: str, key: str, value: str, attr: str) -> Column:
    """Attribute of the first ``<tag key="value" …>``, blank when absent."""
    element = F.regexp_extract(html, rf"""(?i)<{tag}\b[^>]*\b{key}=["']{value}["'][^>]*>""", 0)
    return F.regexp_extract(element, rf"""(?i)\b{attr}=["']([^"']*)["']""", 1)


def visible_text(html: Column) -> Column:
    return X.plain_text(strip_page_shell(html))


def page_facts(crawl: DataFrame) -> DataFrame:
    """One row per page with everything the checks read; the html is read once."""
    h = F.col("html")
    status = F.col("status") if "status" in crawl.columns else F.lit(None).cast("int")
    console = F.col("console_errors") if "console_errors" in crawl.columns else F.lit(None).cast("array<string>")
    facts = crawl.select(
        "url", status.alias("status"), console.alias("console_errors"),
        F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        _tag_attr(h, "meta", "name", "description", "content").alias("description"),
        _tag_attr(h, "link", "rel", "canonical", "href").alias("canonical"),
        _tag_attr(h, "meta", "name", "robots", "content").alias("robots"),
        *[_tag_attr(h, "meta", "property", f"og:{p}", "content").alias(f"og_{p}") for p in ("title", "description", "image")],
        F.regexp_count(h, F.lit(r"(?i)<h1[\s>]")).alias("h1"),
        F.regexp_extract_all(h, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0)).alias("images"),
        F.regexp_extract_all(h, F.lit(r"""(?i)<a\b[^>]*\bhref=["']tel:([^"']*)["']"""), F.lit(1)).alias("tels"),
        h.rlike(r"(?i)<(?:main|header|h1)\b").alias("has_landmark"),
        visible_text(h).alias("text"),
    )
    tels = F.array_distinct(F.filter(F.transform("tels", digits_only), lambda d: d != ""))
    phones = F.array_distinct(F.filter(F.transform(audit_phones(F.col("text")), digits_only), lambda d: F.length(d) >= 10))
    return facts.withColumn("tel_numbers", tels).withColumn("text_numbers", phones)


def _issue(cond: Column, kind: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kind).alias("type"), text.alias("message")))


def _canonical_checks(expected_domain: str | None) -> list[Column]:
    blank = ~X.nonblank(F.col("canonical"))
    checks = [_issue(blank, "seo", "Missing canonical URL")]
    if expected_domain:
        c = X.strip_ws(F.col("canonical"))
        absolute = c.rlike("(?i)^[a-z][a-z0-9+.-]*:")
        host = F.lower(F.try_parse_url(c, F.lit("HOST")))
        checks += [
            _issue(
                ~blank & host.isNotNull() & ~F.contains(host, F.lit(expected_domain)), "seo",
                F.concat(F.lit("Canonical domain mismatch: "), host, F.lit(f" does not match expected domain {expected_domain}")),
            ),
            _issue(~blank & absolute & host.isNull(), "seo", F.concat(F.lit("Invalid canonical URL: "), F.col("canonical"))),
        ]
    return checks


def page_checks(expected_domain: str | None = None) -> Column:
    """All checks on one row of ``page_facts``, as an array of issues."""

    def missing(column: str, label: str) -> Column:
        return _issue(~X.nonblank(F.col(column)), "seo", f"Missing {label}")

    tels, texts = F.col("tel_numbers"), F.col("text_numbers")
    single = F.get(tels, F.lit(0))
    checks = [
        _issue(F.col("status") >= 400, "http", F.concat(F.lit("Page returned status "), F.col("status").cast("string"))),
        _issue(
            (F.length("text") <= MEANINGFUL_CHARS) & ~F.col("has_landmark"), "render", "App did not appear to finish rendering in time"
        ),
        missing("title", "page title"), missing("description", "meta description"), *_canonical_checks(expected_domain),
        _issue(F.contains(F.lower("robots"), F.lit("noindex")), "seo", "Page contains noindex"),
        missing("og_title", "og:title"), missing("og_description", "og:description"), missing("og_image", "og:image"),
        _issue(F.col("h1") == 0, "content", "Missing H1"),
        _issue(F.col("h1") > 1, "content", F.concat(F.lit("Multiple H1 tags found ("), F.col("h1").cast("string"), F.lit(")"))),
        _issue(X.has_placeholder(F.col("text")), "placeholder", 'Found "Lorem Ipsum" text'),
        _issue(F.size("tels") == 0, "conversion", "No tel: links found on page"),
        _issue(
            F.size(tels) > 1, "conversion", F.concat(F.lit("Multiple different tel: numbers found: "), F.array_join(tels, ", "))
        ),
        _issue(
            (F.size(tels) == 1) & (F.size(texts) > 0) & ~F.array_contains(texts, single), "conversion",
            F.concat(
                F.lit("Visible phone number text may not match tel: link number. tel: "), single, F.lit(" visible: "),
                F.array_join(texts, ", "),
            ),
        ),
        _issue(
            F.size("console_errors") > 0, "console", F.concat(F.lit("Console errors found: "), F.array_join("console_errors", " | "))
        ),
    ]
    src = """(?i)\\bsrc=["']([^"']*)["']"""

    def image_issue(img: Column) -> Column:
        alt = F.regexp_extract(img, r"""(?i)\balt=["']([^"']*)["']""", 1)
        url = F.when(img.rlike(src), F.regexp_extract(img, src, 1)).otherwise("unknown src")
        return _issue(~X.nonblank(alt), "accessibility", F.concat(F.lit("Image missing alt text: "), url))

    found = F.concat(F.array(*checks), F.transform("images", image_issue))
    return F.filter(found, lambda i: i.isNotNull())


def page_issues(crawl: DataFrame, expected_domain: str | None = None) -> DataFrame:
    facts = page_facts(crawl)
    return facts.select("url", F.explode(page_checks(expected_domain)).alias("i")).select("url", "i.type", "i.message")


def word_table(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct checked words per page, found inside the row: ``key, word``."""
    raw = F.split(F.lower(text), WORD_BREAK)
    cleaned = F.filter(F.transform(raw, lambda w: F.regexp_replace(w, "[^a-z']", "")), lambda w: F.length(w) > 2)
    return df.select(key, F.explode(F.array_distinct(cleaned)).alias("word"))


def misspellings(words: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Words in the dictionary ``(word, correction)`` and not in the allow-list ``(word)``.

    The allow-list is taken off the dictionary, not off the words.
    """
    usable = dictionary if allowed is None else dictionary.join(allowed.select("word"), "word", "left_anti")
    return words.join(usable.dropDuplicates(["word"]), "word")


def spelling_issues(crawl: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    hits = misspellings(word_table(crawl, "url", visible_text(F.col("html"))), dictionary, allowed)
    message = F.concat(F.lit('Possible misspelling: "'), F.col("word"), F.lit('" (did you mean "'), F.col("correction"), F.lit('"?)'))
    return hits.select("url", F.lit("spelling").alias("type"), message.alias("message"))


def link_issues(crawl: DataFrame, origin: str) -> DataFrame:
    """Broken internal links, and internal links that are no valid URL."""
    links = checked_links(crawl, "url", "html", origin)
    bad = broken_links(links, crawl)
    broken = bad.select(
        "url", F.lit("links").alias("type"),
        F.concat(F.lit("Broken internal link: "), F.col("href"), F.lit(" returned "), F.col("target_status").cast("string")).alias("message"),
    )
    invalid = links.where(F.try_parse_url("target", F.lit("HOST")).isNull()).select(
        "url", F.lit("links").alias("type"), F.concat(F.lit("Invalid internal link: "), F.col("href")).alias("message")
    )
    return broken.unionByName(invalid)


def scan(crawl: DataFrame, origin: str, expected_domain: str | None = None, dictionary: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Every check over a crawl table."""
    found = page_issues(crawl, expected_domain).unionByName(link_issues(crawl, origin))
    return found if dictionary is None else found.unionByName(spelling_issues(crawl, dictionary, allowed))


def report(issues: DataFrame) -> DataFrame:
    """Issues and affected URLs per type and message."""
    per_url = issues.groupBy("type", "message", "url").agg(F.count("*").alias("n"))
    return per_url.groupBy("type", "message").agg(F.sum("n").alias("issues"), F.count("*").alias("urls"))
