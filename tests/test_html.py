import re

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H, text as X
from pagemill.operators import blocks as B
from pagemill.operators import sections as S
from pagemill.operators import tokens as T
from pagemill.operators.cleaning import CleaningOptions, clean_records, normalize_html

L = F.lit


def main(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r["html"] for r in T.extract_main_content(df, "id", "html").orderBy("id").collect()]


def test_absolute_urls(ev):
    raw = '<a href=" /a"><a href="b/c"><img src="//cdn.x/y"><img srcset="a.jpg 2x, /b.jpg 3x"><a href="#k"><a href="tel:1"><a href="https://z/"><a href="">'
    want = '<a href="https://e.com/a"><a href="https://e.com/b/c"><img src="https://cdn.x/y"><img srcset="https://e.com/a.jpg 2x, https://e.com/b.jpg 3x"><a href="#k"><a href="tel:1"><a href="https://z/"><a href="">'
    assert ev(H.absolute_urls(L(raw), "https://e.com")) == want


def test_inline_markup(ev):
    assert ev(H.clean_inline_markup(L("<b><b>x</b></b><i></i>"))) == "<strong>x</strong>"
    assert ev(H.clean_inline_markup(L("<span style='1'>q<span>r</span></span>"))) == "qr"
    assert ev(H.clean_inline_markup(L("<span lang='d'>z</span>"))) == "<span lang='d'>z</span>"


def test_headings(ev):
    assert ev(H.normalize_headings(L("<h1>a</h1><h1 x='1'>b</h1><h4>c</h4><h5>d</h5>"))) == "<h1>a</h1><h2 x='1'>b</h2><h3>c</h3><h4>d</h4>"
    assert ev(H.normalize_headings(L("<h2>a</h2><h3>b</h3>"))) == "<h2>a</h2><h3>b</h3>"


def test_duplicate_blocks(ev):
    a, b = "<p>This is a longer paragraph one.</p>", "<p class='k'>This is a longer paragraph ONE!</p>"
    assert ev(H.remove_duplicate_blocks(L(a + "<p>short</p>" + b + "<p>short</p>"))) == a + "\n<p>short</p>\n<p>short</p>"
    assert ev(H.remove_duplicate_blocks(L(a + " gap <p>other</p>"))) == a + " gap <p>other</p>"


def test_empty_elements(ev):
    assert ev(H.remove_empty_elements(L("<div><p> &nbsp;<br/></p><span></span></div>k"))) == "k"
    assert ev(H.remove_empty_wrappers(L("<div><section> </section></div><p></p>"))) == "<p></p>"
    assert ev(H.clean_empty_html(L("<p>" + " " * 20000 + "</p>x"))) == "x"


def test_many_empty_elements_are_few_passes(ev):
    """As many passes as they are nested, not as many as there are."""
    import time

    page = "<div><p>x</p><span></span></div>" * 30_000
    begin = time.perf_counter()
    assert ev(H.clean_empty_html(L(page))) == "<div><p>x</p></div>" * 30_000
    assert time.perf_counter() - begin < 20
    assert ev(H.clean_empty_html(L("<div>" * 300 + "</div>" * 300 + "k"))) == "k"


def test_page_shell(ev):
    raw = "<!DOCTYPE html><html><head><title>t</title></head><body class='x'><script>a</script><!-- c --><p>k</p></body></html>"
    assert ev(H.strip_page_shell(L(raw))) == "<p>k</p>"
    assert ev(H.strip_page_shell(L("<html><body><p>open"))) == "<p>open"


def test_main_content_unwraps_builder_layout(spark):
    page = (
        '<div class="et_pb_section"><div class="et_pb_row"> <div class="et_pb_column_2_3"><div class="et_pb_text_inner"><h2>Hi</h2><p>Main</p></div></div>'
        '<div class="et_pb_column_1_3"><p>Side</p></div></div></div>'
    )
    assert main(spark, page) == ["<h2>Hi</h2><p>Main</p>"]


@pytest.mark.parametrize("page,want", [
    ("<main><p>x</p><aside><p>side</p></aside></main>", "<p>x</p>"),
    ('<div class="foo"><p>keep</p></div>', "<div><p>keep</p></div>"),
    ("<div>" * 10 + "<p>deep</p>" + "</div>" * 10, "<p>deep</p>"),
    ("<p>a</p><div>never closed <p>b</p>", "<p>a</p><div>never closed <p>b</p>"),
    ("<p>a</p></div><div><p>b</p></div>", "<p>a</p></div><p>b</p>"),
    ('<div class="wrapper"><section class="hero"><p>q</p></section></div>', "<section><p>q</p></section>"),
    ("plain text", "plain text"), (None, None), ("  ", "  "),
])
def test_main_content_cases(spark, page, want):
    assert main(spark, page) == [want]


def test_sidebar_goes_only_when_large_enough(spark):
    small = '<div class="sidebar">x</div>' + "<p>" + "long text " * 100 + "</p>"
    large = '<div class="sidebar"><p>' + "side " * 100 + "</p></div><p>main</p>"
    got = main(spark, small, large)
    assert "x" in got[0][:20] and got[1] == "<p>main</p>"


def test_tokens_rebuild_the_page(spark):
    page = "x <div a='1'>y<p>z</div> <section/> t"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    tokens = T.tokenize(df, "id", "html", ["div", "section"])
    assert T.reassemble(tokens, "id", "html").first()["html"] == page


def test_nesting_matches_a_depth_scan(spark):
    page = "<div><div></div><div><p></div></div></p><div>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    rows = {r["pos"]: r["close_pos"] for r in T.with_close(T.tokenize(df, "id", "html", ["div", "p"]), "id").where("kind = 'open'").collect()}
    assert rows == {0: 6, 1: 2, 3: 5, 4: 7, 8: None}


def test_no_text_is_sorted(spark):
    """Pages are hashed once by key, and only the index of their tags is sorted."""
    df = spark.createDataFrame([(1, "<p>x</p>")], "id int, html string")
    plan = normalize_html(df, "id", "html")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sorted_columns = [set(re.sub(r"#\d+L?", "", x).split(", ")) for x in re.findall(r"\) Sort\b.*?\nInput \[\d+\]: \[(.*?)\]", plan)]
    assert sorted_columns and not any(x & {"html", "_shell", "_piece", "head", "tail", "attrs"} for x in sorted_columns)
    exchanges = [re.sub(r"#\d+", "", x) for x in re.findall(r"\) Exchange\b.*?\nInput \[\d+\]: \[(.*?)\]", plan)]
    assert exchanges == ["id, html"] * 2  # the same one, used twice


def test_secondary_filter(ev):
    intro = "<p>This is the intro with more than ten words in it so that it is surely kept in.</p>"
    posts = '<h2>Recent Posts</h2><ul><li><a href="/a">A one</a></li><li><a href="/b">B</a></li><li><a>C</a></li></ul>'
    about = "<h2>About</h2><p>" + "word " * 60 + "</p><h4>Contact Us</h4><p>call 555-555-5555</p><h3>Other</h3><p>stay</p>"
    got = ev(B.filter_secondary(L(intro + posts + about)))
    assert "Recent" not in got["html"] and "Contact" not in got["html"] and got["html"].endswith("<h3>Other</h3><p>stay</p>")
    assert [r["reason"] for r in got["removed"]] == ["contact-widget", "post-listing"]


def test_secondary_filter_never_empties(ev):
    raw = "<h2>Contact Us</h2><p>x</p>"
    assert ev(B.filter_secondary(L(raw)))["html"] == raw


def test_contact_blocks_by_template(ev):
    raw = "<p>" + "word " * 20 + '</p><h2>Our Office</h2><p>512-555-0100 <a href="mailto:a@b.c">m</a></p>'
    assert "Office" in ev(B.filter_secondary(L(raw), B.FilterOptions("post")))["html"]
    assert "Office" not in ev(B.filter_secondary(L(raw), B.FilterOptions("practice")))["html"]


def test_custom_detector(ev):
    options = B.FilterOptions(detectors=[lambda heading, html: F.when(F.contains(html, L("zap")), "mine")])
    got = ev(B.filter_secondary(L("<p>" + "w " * 12 + "</p><h2>X</h2><p>zap</p>"), options))
    assert [r["reason"] for r in got["removed"]] == ["mine"]


def test_sections(ev):
    assert ev(S.split_on_h2(L("<p>intro</p><h2>a</h2>x<h2>b</h2>y"))) == ["<p>intro</p><h2>a</h2>x", "<h2>b</h2>y"]
    assert ev(S.split_on_h2(L(" no "))) == ["no"]
    assert ev(S.split_on_h2(L(""))) == []
    long = "<p>" + "long text " * 10 + "</p>"
    assert ev(S.drop_thin_sections(F.array(L("<h2>x</h2>"), L(long)))) == [long]
    assert ev(S.drop_thin_sections(F.array(L("<h2>x</h2>")))) == ["<h2>x</h2>"]


def test_paragraph_groups(ev):
    heading_kept = "<p>" + "w " * 410 + "</p><h3>t</h3>" + "<p>" + "v " * 410 + "</p>"
    got = ev(S.split_by_paragraphs(L(heading_kept)))
    assert len(got) == 2 and got[1].startswith("<h3>t</h3>")
    intro = "<p>" + "w " * 395 + "</p><p>short intro to it</p><ul><li>a</li></ul><p>" + "v " * 20 + "</p>"
    assert ev(S.split_by_paragraphs(L(intro + "<p>x y z</p>")))[0].endswith("</ul>")
    assert [(b["tag"], b["words"]) for b in ev(S.top_level_blocks(L("<div><div>a b</div> c</div> loose <b>t</b> <hr/><p>unclosed")))] == [
        ("div", 3), ("text", 2), ("hr", 0), ("p", 1)
    ]


FAQ = "<h2>Main</h2><p>Body</p><h2>FAQ</h2><h3>What is it?</h3><p>It is a thing of note.</p><h3>Why?</h3><p>Because.</p>"


def test_faq(ev):
    found = ev(S.detect_faq(L(FAQ)))
    assert [(p["question"], p["answer"]) for p in found] == [("What is it?", "<p>It is a thing of note.</p>"), ("Why?", "<p>Because.</p>")]
    assert ev(S.remove_faq(L(FAQ), S.detect_faq(L(FAQ)))) == "<h2>Main</h2><p>Body</p>"
    assert ev(S.detect_faq(L("<h3>One?</h3><p>x</p>"))) == []
    assert len(ev(S.extract_faq(L("<p><strong>One?</strong> yes</p>")))) == 1


def test_section_images(ev):
    bodies = F.array(L('<p>a</p><figure> <img alt="x" src="/i.png"> <figcaption>c</figcaption></figure>k'), L('<p> <img src="q"></p><img src="z">'), L("n"))
    got = ev(S.extract_section_images(S.sections_from_bodies(bodies)))
    assert [(s["body"], s["image"], s["imageAlt"]) for s in got] == [("<p>a</p>k", "/i.png", "x"), ('<img src="z">', "q", ""), ("n", "", "")]
    assert [(s["imagePosition"], s["showCTAs"]) for s in got] == [("right", True), ("left", False), ("right", True)]


def test_form_segments(ev):
    assert [(s["kind"], s["value"]) for s in ev(H.form_segments(L("a{{form: x }}b")))] == [("html", "a"), ("form", "x"), ("html", "b")]


def test_clean_records(spark):
    df = spark.createDataFrame(
        [(1, " T&amp;x ", '<div class="et_pb_row">[vc_row]<p>' + "hello " * 30 + "</p></div><p></p>", "<p>short</p>"), (2, None, " ", "k")],
        "id int, title string, body string, other string",
    )
    one, two = clean_records(df, "id", CleaningOptions()).orderBy("id").collect()
    assert one["title"] == "T&x" and one["body"].startswith("<p>hello") and one["other"] == "<p>short</p>"
    assert [(e["field"], e["action"]) for e in one["cleaning_log"]] == [
        ("title", "fix_encoding"), ("title", "normalize_whitespace"), ("body", "strip_shortcodes"), ("body", "clean_empty_html"), ("body", "normalize_html"),
    ]
    assert (two["title"], two["body"], two["other"], two["cleaning_log"]) == (None, " ", "k", [])


def test_texts_without_structural_tags_pass(spark):
    """They need no tag index; a page of which nothing stays is still empty."""
    texts = {1: "plain < text & more", 2: "<p>One</p> <p>two</p>", 3: "<aside><p>gone</p></aside>", 4: "<div><p>in</p></div>"}
    df = spark.createDataFrame(list(texts.items()), "id int, html string")
    out = T.extract_main_content(df, "id", "html")
    tagged = df.where(T.has_tags(F.col("html"), T.STRUCTURE_TAGS)).collect()
    assert {r["id"] for r in tagged} == {3, 4}
    got = {r["id"]: r["html"] for r in out.collect()}
    assert got == {1: texts[1], 2: texts[2], 3: "", 4: "<p>in</p>"}


def test_pages_are_cleaned_once(spark):
    """Both uses of a page read one exchange, also where several columns may hold pages, so no step before it runs twice."""
    df = spark.createDataFrame([(1, "t", "<div><p>Some text.</p></div>"), (2, "u", "<p>More.</p>")], "id long, title string, body string")
    out = clean_records(df, "id")
    assert [tuple(r) for r in out.select("id", "title", "body").orderBy("id").collect()] == [(1, "t", "<p>Some text.</p>"), (2, "u", "<p>More.</p>")]
    out.foreach(lambda _: None)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_null_keys_stay_rows(spark):
    df = spark.createDataFrame([(None, "t", "plain"), (0, "u", "<div><p>Zero.</p></div>")], "id long, title string, body string")
    assert [tuple(r) for r in clean_records(df, "id").select("id", "title", "body").orderBy("id").collect()] == [(None, "t", "plain"), (0, "u", "<p>Zero.</p>")]


def test_blocks_that_begin_alike(ev):
    long = "<p>" + "Same words &amp; <b>more</b> of them. " * 30
    first, second = long + "one</p>", long + "two</p>"
    copy = "<p class='k'>" + first[3:]
    assert ev(H.remove_duplicate_blocks(L(first + " gap " + second))) == first + " gap " + second
    assert ev(H.remove_duplicate_blocks(L(first + " gap " + second + copy))) == first + "\n" + second
    # Starts without text of their own: attributes, or letters that a fingerprint leaves out.
    bare = "<p title='" + "x" * 500 + "'>"
    body = "These are words enough for a fingerprint that counts.</p>"
    assert ev(H.remove_duplicate_blocks(L(bare + body + "<p>" + body))) == bare + body


def test_words_and_spaces(ev):
    text = "  a b\tc  d　\ne é "
    assert ev(X.word_count(L(text))) == 6
    assert ev(X.squeeze(L(text))) == "a b c d e é"
    assert ev(X.normalize_whitespace(L(text))) == "a b c d \ne é"
    assert [ev(X.word_count(L(t))) for t in ("", " \n", "x")] == [0, 0, 1]
    assert [ev(X.strip_long(L(t))) for t in ("", " <p>\n", "<p>é ", "é", "<p>")] == ["", "<p>", "<p>é", "é", "<p>"]


def test_starts_tell_of_wholes(ev):
    for n in range(1, 60):
        text = "<p>ab &amp; <b class='c'>d</b> e &x; <i"
        start, whole = ev(X.plain_text(X.safe_start(L(text), n))), ev(X.plain_text(L(text)))
        assert whole.startswith(start) or n > len(text)


def test_secondary_sections_after_long_ones(ev):
    keep = "<h2>Our work</h2><p>" + "word " * 400 + "</p>"
    posts = "<h2>Recent posts</h2><ul><li><a href='/a'>A one</a></li><li><a href='/b'>B</a></li></ul>"
    sub = "<h2>More</h2><p>" + "word " * 400 + "</p><h3>Newsletter</h3><p>Sign up.</p>"
    got = ev(B.filter_secondary(L("<p>" + "intro " * 20 + "</p>" + keep + posts + sub)))
    assert [r["reason"] for r in got["removed"]] == ["newsletter-widget", "post-listing-widget"]
    assert got["html"] == "<p>" + "intro " * 20 + "</p>\n" + keep + "\n" + sub.split("<h3>")[0]
