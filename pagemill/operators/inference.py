"""Rules inferred from pairs of a mapped sample and its corrected output.

Tables in, rules out: the mapped fields and the output fields of each sample are unpivoted
and joined per sample, so many samples are handled at once; the majority rule per target wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.operators.rules import Recipe, Rule
from pagemill.functions import text as X
from pagemill.operators.sections import FAQ_TYPE

STATIC_MAX = 200
SIMILAR = 0.9
#: Characters of a longer value whose slug tells how long the whole slug is at least.
SLUG_HEAD = 512


def unpivot(df: DataFrame, sample: str, columns: list[str], prefix: str) -> DataFrame:
    """``sample, <prefix>_no, <prefix>_key, <prefix>_value``; nulls dropped, order kept."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)
    ])
    rows = df.select(sample, F.explode(pairs).alias("p")).where(F.col("p.value").isNotNull())
    return rows.select(sample, F.col("p.no").alias(f"{prefix}_no"), F.col("p.key").alias(f"{prefix}_key"), F.col("p.value").alias(f"{prefix}_value"))


def _text_words(value: Column, plain) -> Column:
    """Number of distinct words in the text of a value that has tags: only such a value can have been cleaned."""
    return F.when(F.contains(value, F.lit("<")), F.size(F.array_distinct(X.words(F.lower(plain(value))))))


def infer_from_diff(mapped: DataFrame, output: DataFrame, sample: str) -> DataFrame:
    """One row per sample and output field: ``rule_type, source_fields, prefix, static_value``.

    Tiers in order: exact copy, slug, path from slug, static value, concatenation, cleaned
    HTML, else ``ambiguous``. The pairs are the fields of one sample, a bounded set.
    """
    def plain(c: Column) -> Column:
        return X.strip_ws(X.strip_tags(c))

    # Short facts of one value are computed once per value, before the pairs exist; what is as long as the value is not sent along.
    value = F.col("mapped_value")
    long = F.length(value) > SLUG_HEAD
    m = mapped.select(
        sample, "mapped_no", "mapped_key", value.alias("_src"), F.when(~long, X.slugify(value)).alias("_short_slug"),
        F.when(long, F.length(X.slugify(F.substring(value, 1, SLUG_HEAD)))).alias("_slug_head"),
        X.tag_count(value).alias("_src_tags"), _text_words(value, plain).alias("_src_words"),
    )
    o = output.where(X.nonblank(F.col("output_value"))).withColumn("_text", plain(F.col("output_value"))).withColumn(
        "_tags", X.tag_count(F.col("output_value"))
    ).withColumn("_words", F.size(F.array_distinct(X.words(F.lower("_text")))))
    pairs = o.join(m, sample, "left")
    src, out = F.col("_src"), F.col("output_value")
    # The slug of a long value is at least as long as that of its head, give or take a character at the cut.
    pairs = pairs.withColumn("_slug", F.when(F.col("_slug_head").isNull(), F.col("_short_slug")).when(F.col("_slug_head") - 3 <= F.length(out), X.slugify(src)))
    slug = F.col("_slug")
    tier = (
        F.when(src == out, 1)
        .when((slug != "") & (out == slug), 2)
        .when(out == F.concat(F.lit("/"), slug, F.lit("/")), 3)
    )
    contained = (F.length(src) > 3) & F.contains(out, src)
    related = (F.length(src) > 3) & (F.length(out) > 3) & (F.contains(out, src) | F.contains(src, out))
    # Two sets are no more alike than their sizes.
    near = F.least("_src_words", "_words") > SIMILAR * F.greatest("_src_words", "_words") * 0.999
    cleaned = F.when(
        (F.length("_text") > 20) & (F.col("_src_tags") > F.col("_tags")) & near,
        X.once(plain(src), lambda text: (F.length(text) > 20) & (X.jaccard(text, F.col("_text")) > SIMILAR)),
    )
    facts = pairs.select(
        sample, "output_no", "output_key", "output_value", "mapped_no", "mapped_key", tier.alias("_tier"),
        F.coalesce(related, F.lit(False)).alias("_rel"), F.coalesce(contained, F.lit(False)).alias("_in"),
        F.coalesce(cleaned, F.lit(False)).alias("_clean"),
    )
    grouped = facts.groupBy(sample, "output_no", "output_key", "output_value").agg(
        F.min_by("mapped_key", F.when(F.col("_tier") == 1, F.col("mapped_no"))).alias("copy"),
        # Slug and path form one pass over the mapped fields: the first field with either wins.
        F.min_by(F.struct("mapped_key", "_tier"), F.when(F.col("_tier").isin(2, 3), F.col("mapped_no"))).alias("slug"),
        F.bool_or("_rel").alias("related"),
        F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("mapped_no", "mapped_key")))).alias("inside"),
        F.min_by("mapped_key", F.when(F.col("_clean"), F.col("mapped_no"))).alias("clean"),
    )
    has_slug = F.col("slug").isNotNull() & F.col("slug._tier").isNotNull()
    static = ~F.col("related") & (F.length("output_value") < STATIC_MAX)
    kind = (
        F.when(F.col("copy").isNotNull(), "direct_map").when(has_slug, "slugify").when(static, "static_value")
        .when(F.size("inside") >= 2, "concat").when(F.col("clean").isNotNull(), "html_clean").otherwise("ambiguous")
    )
    inside = F.transform("inside", lambda x: x["mapped_key"])
    fields = (
        F.when(kind == "direct_map", F.array("copy")).when(kind == "slugify", F.array("slug.mapped_key"))
        .when(kind == "concat", inside).when(kind == "html_clean", F.array("clean")).otherwise(F.array().cast("array<string>"))
    )
    return grouped.select(
        sample, "output_no", F.col("output_key").alias("target_field"), kind.alias("rule_type"), fields.alias("source_fields"),
        F.when((kind == "slugify") & (F.col("slug._tier") == 3), "/").otherwise("").alias("prefix"),
        F.when(kind == "static_value", F.col("output_value")).alias("static_value"),
        F.lit("diff").alias("inferred_from"),
    )


def has_faq_markup(body: Column) -> Column:
    questions = F.filter(
        F.regexp_extract_all(body, F.lit(r"(?is)<h3[^>]*>(.*?)</h3>"), F.lit(1)),
        lambda h: F.endswith(X.strip_ws(X.strip_tags(h)), F.lit("?")),
    )
    return (
        (F.regexp_count(body, F.lit(r"(?i)<dt[^>]*>")) >= 2) | (F.size(questions) >= 2)
        | (F.regexp_count(body, F.lit(r"(?is)<(?:strong|b)[^>]*>.*?\?\s*</(?:strong|b)>")) >= 2)
    )


def infer_from_patterns(
    df: DataFrame, sample: str, template: str, body: Column, title: Column, meta_title: Column,
    faq_items: Column | None = None, hero_image: Column | None = None, mapped_image: Column | None = None,
) -> DataFrame:
    """Structural rules of each sample: section split, FAQ, hero image, meta-title suffix."""
    text = F.coalesce(body, F.lit(""))
    h2 = text.rlike(r"(?i)<h2[\s>]")

    def rule(cond: Column, target: str, kind: str, mode: Column) -> Column:
        return F.when(
            F.coalesce(cond, F.lit(False)),
            F.struct(F.lit(target).alias("target_field"), F.lit(kind).alias("rule_type"), mode.alias("mode")),
        )

    found = []
    if template == "practice":
        given = F.coalesce(F.size(faq_items if faq_items is not None else F.lit(None).cast(FAQ_TYPE)), F.lit(0)) >= 2
        image = X.null_if_empty(hero_image) if hero_image is not None else F.lit(None).cast("string")
        have = X.null_if_empty(mapped_image) if mapped_image is not None else F.lit(None).cast("string")
        found = [
            rule(h2 | (F.length(text) > 500), "contentSections", "h2_split", F.when(h2, "h2").otherwise("paragraph_groups")),
            rule(has_faq_markup(text) | (given & (text != "")), "faq", "faq_extract", F.lit("")),
            rule(image.isNotNull() & have.isNull(), "hero", "hero_extract", F.lit("first_image")),
        ]
    suffix = X.strip_ws(X.replace_first(meta_title, title, F.lit("")))
    found.append(
        rule((title != "") & (meta_title != title) & F.contains(meta_title, title) & (suffix != ""), "meta_title", "concat",
             F.concat(F.lit("{{title}}"), suffix))
    )
    rules = F.filter(F.array(*found), lambda r: r.isNotNull())
    return df.select(sample, F.posexplode(rules).alias("output_no", "r")).select(
        sample, "output_no", "r.target_field", "r.rule_type", "r.mode", F.lit("pattern").alias("inferred_from")
    )


def merge_tiers(diff: DataFrame, patterns: DataFrame, sample: str) -> tuple[DataFrame, DataFrame]:
    """Rules (pattern rules only for fields the diff left open) and the fields still ambiguous."""
    covered = diff.where("rule_type <> 'ambiguous'")
    cols = [sample, "target_field", "rule_type", "inferred_from"]
    more = patterns.join(covered.select(sample, "target_field"), [sample, "target_field"], "left_anti")
    rules = covered.select(*cols, F.lit(1).alias("_t"), "output_no").unionByName(
        more.select(*cols, F.lit(2).alias("_t"), "output_no")
    )
    w = Window.partitionBy(sample).orderBy("_t", "output_no")
    rules = rules.select(*cols, F.concat(F.lit("rule_"), F.row_number().over(w)).alias("rule_id"))
    ambiguous = diff.where("rule_type = 'ambiguous'").join(patterns.select(sample, "target_field"), [sample, "target_field"], "left_anti")
    return rules, ambiguous.select(sample, "target_field")


def inference_confidence(rules: DataFrame, sample: str) -> DataFrame:
    share = F.sum(F.when(F.col("inferred_from") == "diff", 1.0).otherwise(0.8)) / F.count("*")
    return rules.groupBy(sample).agg(X.round2(share).alias("confidence"), F.count("*").alias("n_rules"))


def majority_rules(diff: DataFrame) -> DataFrame:
    """Over many samples: the rule most samples agree on, per target."""
    sig = F.struct("rule_type", "source_fields", "prefix", "static_value")
    counts = diff.where("rule_type <> 'ambiguous'").groupBy("target_field", sig.alias("rule")).agg(F.count("*").alias("samples"))
    best = counts.groupBy("target_field").agg(
        F.max_by("rule", F.struct("samples", "rule")).alias("rule"), F.max("samples").alias("samples")
    )
    return best.select("target_field", "rule.*", "samples")


def infer_recipe(majority: DataFrame, template: str = "post", name: str = "") -> Recipe:
    """A recipe that ``run_recipe`` takes, from the table of ``majority_rules``: one row per target field, control data."""
    rules = []
    for i, r in enumerate(majority.orderBy("target_field").collect(), 1):
        sources = list(r["source_fields"] or [])
        config = {
            "static_value": {"value": r["static_value"]}, "concat": {"fields": sources},
            "slugify": {"sourceField": sources[0] if sources else "title", "prefix": r["prefix"] or ""},
        }.get(r["rule_type"], {"sourceField": sources[0]} if sources else {})
        rules.append(Rule(f"rule_{i}", r["target_field"], r["rule_type"], config, inferred_from="diff"))
    return Recipe(rules, template=template, name=name)
