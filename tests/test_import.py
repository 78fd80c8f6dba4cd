import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pagemill.operators import inference as N
from pagemill.operators.mapping import FieldMapping, Mapping, auto_map, suggestions, suggestions_table
from pagemill.operators.rules import Fields, Recipe, Rule, outcome, register_rule, RuleResult, run_rule
from pagemill.operators.slugs import resolve_collisions
from pagemill.operators.templates import grouped_fields, mappable_fields, registry, repeater_children, required_fields
from pagemill.operators.validation import duplicate_issues, form_checks, validate_scored, validation_totals
from pagemill.plans.engine import EngineOptions, engine_totals, prepare_records, reset_to_auto, run_recipe
from pagemill.session import checkpoint

L = F.lit
AT = datetime(2024, 1, 1, tzinfo=timezone.utc)
BODY = (
    "<h1>PI</h1><p>Intro words that lead in.</p><h2>One</h2><p>" + "alpha " * 20 + '</p><figure><img src="/x.png" alt="A"></figure><h2>Two</h2><p>' + "beta " * 30
    + "</p><h2>FAQ</h2><h3>What now?</h3><p>Do the thing right away please.</p><h3>Why so?</h3><p>Because of reasons that matter.</p>"
)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(
        [
            (0, "Personal Injury", "https://e.com/practice-areas/personal-injury/", BODY, "https://e.com/a.jpg", "1713627000"),
            (1, "Personal Injury", "https://e.com/practice-areas/personal-injury/", "plain\n\ntext", None, "April 20, 2024"),
            (2, None, None, None, None, None),
        ],
        "i int, title string, url string, body string, featured_image string, published_at string",
    )


def test_registry(spark):
    assert registry(spark).groupBy("template").count().orderBy("template").collect()[0]["count"] == 14
    assert len(mappable_fields("practice")) == 21
    assert [f.key for f in repeater_children("practice", "faq.items")] == ["faq.items.question", "faq.items.answer"]
    assert [f.key for f in required_fields("post")] == ["title", "slug"]
    assert grouped_fields(spark).where("template = 'post' and field_group = 'Content'").first()["keys"] == ["body"]


def test_suggestions_rank_distinct_names(spark):
    """Names are ranked after they are made distinct: no filter takes the ranking below the grouping."""
    rows = spark.createDataFrame([("Title",), ("qqq",), ("image",)] * 50, "name string")
    ranked = suggestions_table(rows, "name", "post").where(F.size("ranked") > 0)
    got = {r["name"]: r["ranked"][0]["score"] for r in ranked.collect()}
    assert got["Title"] == 100 and "image" in got and "qqq" not in got
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" in plan and "transform" not in plan[plan.index("Aggregate"):]


def test_long_values_are_still_slugs(spark):
    """The slug of a long value is compared where the output is long enough, and not sent along with every value."""
    long, tagged = "Word two " * 200, "<div><p>" + " ".join(f"word{i}" for i in range(40)) + "</p></div>"
    slug = "-".join(["word-two"] * 200)
    mapped = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", tagged)], "s int, mapped_no int, mapped_key string, mapped_value string")
    output = spark.createDataFrame([(1, 0, "x", slug), (1, 1, "y", f"/{slug}/"), (1, 2, "z", tagged.replace("<div>", "").replace("</div>", "") + " more")], "s int, output_no int, output_key string, output_value string")
    got = N.infer_from_diff(mapped, output, "s")
    assert {r["target_field"]: (r["rule_type"], r["prefix"]) for r in got.collect()} == {"x": ("slugify", ""), "y": ("slugify", "/"), "z": ("html_clean", "")}


def test_auto_map(spark, ev):
    m = auto_map(spark, ["Title", "post_title", "url", "permalink", "body", "featured_image"], "practice")
    assert [(e.target, e.source) for e in m.entries] == [("title", "Title"), ("url_slug", "url"), ("body", "body"), ("featured_image", "featured_image")]
    assert [s["score"] for s in ev(suggestions(L("image"), "practice"))] == [90, 60, 60, 60]
    assert m.remap("url", "title").entries[-1] == FieldMapping("title", "url")


def test_recipe_run(spark, source):
    recipe = Recipe([
        Rule("r1", "title", "direct_map"), Rule("r2", "contentSections", "h2_split", {"sourceField": "body"}), Rule("r3", "faq", "faq_extract"),
        Rule("r5", "meta_title", "concat", {"fields": ["title"], "template": "{{title}} | Site"}), Rule("r7", "x", "nope"),
        Rule("r8", "og_description", "ai_transform", {"action": "sum"}),
    ])
    mapping = auto_map(spark, source.columns[1:], "practice")
    out = run_recipe(source, "i", mapping, recipe, EngineOptions(site_name="S", slug_mode="unique_suffix", imported_at=AT), failed=F.col("i") == 2)
    out = checkpoint(out)
    a, b, c = out.orderBy("i").collect()
    assert [r["record"]["url_path"] for r in (a, b, c)] == ["/personal-injury/", "/personal-injury-1/", "/untitled/"]
    content = a["record"]["content"]
    assert [s["image"] for s in content["contentSections"]] == ["/x.png", ""] and "FAQ" not in content["contentSections"][1]["body"]
    assert content["contentSections"][0]["body"].startswith("<p>Intro words that lead in.</p><h2>One</h2>")
    assert [q["question"] for q in content["faq"]["items"]] == ["What now?", "Why so?"] and content["faq"]["heading"] == "Frequently Asked Questions"
    assert a["record"]["meta_title"] == "Personal Injury | Site" and a["record"]["published_at"] == "2024-04-20T15:30:00.000Z"
    assert a["record"]["publish_date_source"] == "mapped" and c["record"]["publish_date_source"] == "fallback"
    assert (c["status"], c["confidence"]["overall"], c["confidence"]["flags"]) == ("needs_review", 0.0, ["processing_error"])
    assert [e["rule_id"] for e in a["log"]] == ["r1", "r2", "r3", "r5", "r7", "r8"] and a["log"][4]["description"] == "Unknown rule type: nope"
    totals = engine_totals(out, "i").first()
    assert totals["failed"] == 1 and totals["total"] == 3
    found = validate_scored(out, "i", "record", "confidence", "practice")
    assert {(r["row_index"], r["field"]) for r in found.collect()} >= {(2, "title"), (2, "confidence"), (2, "quality")}
    assert validation_totals(found).first()["error_rows"] == 1


def test_prepare_and_reset(spark, source):
    prepared = checkpoint(prepare_records(source, "i", auto_map(spark, source.columns[1:], "practice"), EngineOptions(site_name="S", imported_at=AT)))
    a, b, c = prepared.orderBy("i").collect()
    assert len(a["auto"]["content"]["contentSections"]) == 2 and len(b["auto"]["content"]["contentSections"]) == 1
    assert a["auto"]["meta_title"] == "Personal Injury | S" and a["status"] == "needs-review"
    assert "Title is required" in [i["message"] for i in c["issues"]]
    edited = prepared.withColumn("current", F.col("current").withField("title", L("Edited"))).withColumn("status", L("approved"))
    back = reset_to_auto(edited, F.col("i") == 0, "practice").orderBy("i").collect()
    assert (back[0]["current"]["title"], back[0]["status"]) == ("Personal Injury", "needs-review")
    assert (back[1]["current"]["title"], back[1]["status"]) == ("Edited", "approved")


def test_custom_rule(ev):
    @register_rule("shout")
    def shout(fields, config, target):
        return RuleResult(outcome(F.upper(fields.text("title")), 0.7, "structural", "loud"))

    got = ev(run_rule(Rule("r", "t", "shout"), Fields({"title": L("a")})).outcome)
    assert (got["value"], got["score"]) == ("A", 0.7)


def test_bad_pattern_scores_low(ev):
    got = ev(run_rule(Rule("r", "t", "html_extract", {"pattern": "("}), Fields({"body": L("x")})).outcome)
    assert (got["value"], got["score"], got["category"]) == (None, 0.2, "structural")


def brute(slugs, template):
    used, out = set(), []
    for s in slugs:
        new, n = s, 1
        while new in used and n <= 99:
            new = f"/{s.strip('/')}-{n}/" if template == "practice" else re.sub(r"-\d+$", "", s) + f"-{n}"
            n += 1
        used.add(new)
        out.append(new)
    return out


@pytest.mark.parametrize("template", ["post", "practice"])
def test_slug_chains_and_a_large_family(spark, template):
    """Names that are numbers of each other over three levels, and thousands of dated slugs, of which only some compete."""
    rng = random.Random(8)
    pool = ["x"] * 5 + [f"x-{i}" for i in (1, 1, 2, 3, 9)] + [f"x-{i}-{j}" for i in (1, 2) for j in (1, 2, 3)] + ["x-1-1-1", "x-1-1-2", "y-01", "y", "x-0"]
    slugs = [rng.choice(pool) for _ in range(160)] + [f"post-{i % 12 + 1}-{i % 31 + 1}-{i}" for i in range(3000)] + ["post-1-1-0", "post-1-1-0", "post"]
    rng.shuffle(slugs)
    slugs = [f"/{s}/" if rng.random() < 0.9 else s for s in slugs] if template == "practice" else slugs
    df = spark.createDataFrame(list(enumerate(slugs)), "i int, s string")
    got = resolve_collisions(df, "i", "s", template, "unique_suffix", max_suffix=99, unsolved="open").orderBy("i").collect()
    want = brute(slugs, template)
    assert [r["s"] for r in got] == want or [(i, r["s"], w) for i, (r, w) in enumerate(zip(got, want)) if r["s"] != w][:3] == []


@pytest.mark.parametrize("template", ["post", "practice"])
def test_slug_collisions_match_the_ordered_loop(spark, template):
    rng = random.Random(7)
    pool = ["a", "a-1", "a-2", "b", "b-99", "c-1000", "c-1001", "d-05", "a-1-1", "e"] + ["hot"] * 10 + ["hot-7"]
    slugs = [rng.choice(pool) for _ in range(1500)]
    slugs = [f"/{s}/" for s in slugs] if template == "practice" else slugs
    df = spark.createDataFrame(list(enumerate(slugs)), "i int, s string")
    want = brute(slugs, template)
    capped = resolve_collisions(df, "i", "s", template, "unique_suffix", max_suffix=99, unsolved="open").orderBy("i").collect()
    assert [r["s"] for r in capped] == want
    got = [r["s"] for r in resolve_collisions(df, "i", "s", template, "unique_suffix").orderBy("i").collect()]
    assert len(set(got)) == len(got) == 1500
    assert all(g == w for g, w, r in zip(got, want, capped) if not r["open"]) and any(r["open"] for r in capped)
    kept = [r["s"] for r in resolve_collisions(df, "i", "s", template, "skip").orderBy("i").collect()]
    assert kept == slugs


def test_recipe_from_samples_and_json(spark):
    from pagemill.operators.inference import infer_recipe

    rows = [("title", "direct_map", ["name"], None, None, 3), ("slug", "slugify", ["name"], "p-", None, 3), ("og_title", "concat", ["name", "author"], None, None, 2), ("status", "static_value", [], None, "draft", 2)]
    table = spark.createDataFrame(rows, "target_field string, rule_type string, source_fields array<string>, prefix string, static_value string, samples int")
    recipe = infer_recipe(table, "post", "n")
    assert Recipe.from_json(recipe.to_json()) == recipe
    assert {r.target: r.config for r in recipe.rules} == {"title": {"sourceField": "name"}, "slug": {"sourceField": "name", "prefix": "p-"}, "og_title": {"fields": ["name", "author"]}, "status": {"value": "draft"}}
    assert Recipe.from_json('{"name": "x", "other": 1, "rules": [{"id": "a", "target": "t", "rule_type": "ignore", "z": 2}]}').rules[0].rule_type == "ignore"


def test_large_duplicate_groups_keep_every_row(spark):
    df = spark.range(1500).select(F.col("id").alias("r"), L("same").alias("k"))
    got = duplicate_issues(df, "r", "k", "post")
    assert got.count() == 1500 and got.first()["message"] == 'Duplicate slug "same" found in 1500 rows, first in row 1'


def test_form_checks(spark):
    df = spark.createDataFrame(
        [([("text", "a", "", None, None), ("select", "b", "B", None, []), ("html", "", "", " ", None)],)],
        "fields array<struct<type:string,name:string,label:string,html_content:string,options:array<string>>>",
    )
    assert df.select(form_checks(F.col("fields")).alias("m")).first()["m"] == [
        'Field "a" needs a label', 'Field "b" needs at least one option', "html content missing"
    ]


def test_inference_tiers(spark):
    mapped = spark.createDataFrame([(1, "My Title", "<div><p>" + "same words here " * 5 + "</p></div>")], "s int, title string, body string")
    out = spark.createDataFrame(
        [(1, "My Title", "/my-title/", "constant", "<p>" + "same words here " * 5 + "</p>")], "s int, title string, url_path string, kind string, body string"
    )
    m = N.unpivot(mapped, "s", ["title", "body"], "mapped")
    o = N.unpivot(out, "s", ["title", "url_path", "kind", "body"], "output")
    got = {r["target_field"]: r["rule_type"] for r in N.infer_from_diff(m, o, "s").collect()}
    assert got == {"title": "direct_map", "url_path": "slugify", "kind": "static_value", "body": "html_clean"}


def test_mapping_default_and_blank(spark):
    from pagemill.operators.mapping import apply_mapping

    df = spark.createDataFrame([(1, " ", "x")], "i int, a string, b string")
    m = Mapping([FieldMapping("t", "a", default="d"), FieldMapping("u", "b", transform="html"), FieldMapping("v", "gone")])
    assert apply_mapping(df, m, ["i"]).first().asDict() == {"i": 1, "t": "d", "u": "<p>x</p>"}


def test_rows_that_break_a_rule_are_set_apart(spark):
    """The pipeline itself finds the row on which a rule cannot run; its slug stays free for others."""
    register_rule("needs_digits", lambda fields, config, target: RuleResult(
        outcome(fields.text("og_title"), 1.0, "structural", "ok"), error=F.when(~fields.text("og_title").rlike("^[0-9]+$"), F.concat(F.lit("bad "), fields.text("og_title")))))
    rows = [(0, "One", "same", "12"), (1, "Two", "same", "x"), (2, "Three", "same", "7"), (3, "Four", "other", None)]
    df = spark.createDataFrame(rows, "i int, t string, s string, o string")
    mapping = Mapping([FieldMapping("title", "t"), FieldMapping("slug", "s"), FieldMapping("og_title", "o")])
    recipe = Recipe([Rule("r", "og_title", "needs_digits")], template="post")
    out = {r["i"]: r for r in run_recipe(df, "i", mapping, recipe, EngineOptions("post", slug_mode="unique_suffix", imported_at=AT)).collect()}
    assert [out[i]["record"]["slug"] for i in (0, 2, 3)] == ["same", "same-1", "other"]
    assert out[1]["confidence"]["flags"] == ["processing_error"] and out[1]["confidence"]["overall"] == 0 and out[1]["status"] == "needs_review"
    assert out[1]["log"][0]["description"] == "Processing error: bad x" and out[1]["record"]["title"] == "Two" and out[1]["record"]["body"] is None
    assert all("processing_error" not in out[i]["confidence"]["flags"] for i in (0, 2, 3))


def test_written_records_hold_their_text_once(spark, monkeypatch):
    """What a run writes on its way holds neither the source nor the mapped fields beside the record."""
    from pagemill.operators import slugs
    from pagemill.plans import engine

    seen = []
    monkeypatch.setattr(engine, "checkpoint", lambda df: seen.append(set(df.columns)) or checkpoint(df))
    wide = []
    monkeypatch.setattr(slugs, "checkpoint", lambda df: wide.append(set(df.columns)) or checkpoint(df))
    df = spark.createDataFrame([(0, "A", "/x/", BODY), (1, "B", "/x/", BODY)], "i int, title string, url string, html string")
    mapping = Mapping([FieldMapping("title", "title"), FieldMapping("url_slug", "url"), FieldMapping("body", "html")])
    out = run_recipe(df, "i", mapping, Recipe([Rule("r", "title", "direct_map")]), EngineOptions(slug_mode="unique_suffix", imported_at=AT))
    assert [r["url_path"] for r in out.orderBy("i").select("record.url_path").collect()] == ["/x/", "/x-1/"]
    assert len(seen) == 1 and "record" in seen[0] and not seen[0] & {"mapped", "out", "source"}
    # Slugs are read from rows of their own.
    assert wide[0] == {"_order", "_slug"}
