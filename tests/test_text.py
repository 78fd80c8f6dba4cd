from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dates, phones, text as X, urls as U
from pagemill.functions.text import null_if_blank

L = F.lit


@pytest.mark.parametrize("raw,want", [
    ("  Hello, World_x -- y ", "hello-world-x-y"), ("Café crème", "caf-crme"), ("--a--", "a"), ("", ""),
])
def test_slugify(ev, raw, want):
    assert ev(X.slugify(L(raw))) == want


def test_white_space_class(ev):
    assert ev(X.strip_ws(L(" ﻿ a b 　\n"))) == "a b"
    assert ev(X.squeeze(L("a   b\t\nc"))) == "a b c"
    assert ev(X.normalize_whitespace(L(" a​  \t b\n\n\n\nc "))) == "a b\n\nc"
    assert ev(null_if_blank(L(" "))) is None


def test_long_space_run_is_fast(ev):
    assert ev(X.strip_ws(L("a" + " " * 20000 + "b"))) == "a" + " " * 20000 + "b"


def test_encoding(ev):
    assert ev(X.fix_encoding(L("&#65;&#x42;&#0;&#99999999; &amp;nbsp; &copy;"))) == "AB&#0;&#99999999;   ©"
    assert ev(X.fix_encoding(L("cafÃ© â\u0080\u0099"))) == "café ’"


def test_shortcodes(ev):
    assert ev(X.strip_shortcodes(L('[vc_row a="b"]x[/vc_row][gallery][row]y[/row]'))) == "x[gallery]y"


def test_ensure_html(ev):
    assert ev(X.ensure_html(L("one\ntwo\n\n three "))) == "<p>one<br>two</p><p>three</p>"
    assert ev(X.ensure_html(L("<b>x</b>"))) == "<b>x</b>"
    assert ev(X.ensure_html(L("  "))) == ""


def test_markdown(ev):
    assert ev(X.markdown_to_html(L("# T\n\n**b** [l](u)\n- a\n- b"))) == '<h1>T</h1><p><strong>b</strong> <a href="u">l</a></p><ul><li>a</li><li>b</li></ul>'


def test_rounding_is_half_up_by_arithmetic(ev):
    assert ev(X.round2(L(0.795))) == 0.8
    assert ev(X.round2(L(0.285))) == 0.28


@pytest.mark.parametrize("raw,want", [
    ("https://e.com/practice-areas/personal-injury/", "personal-injury"), ("/a/b/c/", "c"), ("bare", "bare"), ("/", "my-title"),
    ("/practice-areas/x/?q=1", "x"),
])
def test_import_slug(ev, raw, want):
    assert ev(U.import_slug(L(raw), L("My Title"))) == want


def test_paths(ev):
    assert ev(U.cms_path(L("https://e.com/a//"))) == "/a/"
    assert ev(U.cms_path(L(""))) == "/"
    assert ev(U.enforce_trailing_slash(L("/a//b?x=1#y"))) == "/a/b/?x=1#y"
    assert ev(U.stored_slug(L("/a/"))) == "a/"


@pytest.mark.parametrize("raw,want", [
    ("//cdn.x/y", "https://cdn.x/y"), ("mailto:a@b", "mailto:a@b"), ("example.com/x", "https://example.com/x"), ("./about", "/about"), ("", ""), ("/x", "/x"),
])
def test_link_href(ev, raw, want):
    assert ev(U.link_href(L(raw))) == want


def test_query_params_are_decoded(ev):
    assert ev(U.query_param(L("https://e.com/?utm_source=a%20b+c&utm_source=z#f"), "utm_source")) == "a b c"
    assert ev(U.query_param(L("https://e.com/"), "gclid")) == ""


def test_http_urls(ev):
    assert ev(U.is_http_url(L("https://e.com"))) is True
    assert ev(U.is_http_url(L("ftp://e.com"))) is False
    assert ev(U.is_http_url(L("not a url"))) is False
    assert ev(U.redirect_target(L("https://e.com"))) == "https://e.com/"


@pytest.mark.parametrize("raw,want", [
    ("1713627000000", "2024-04-20T15:30:00.000Z"), ("1713627000", "2024-04-20T15:30:00.000Z"), ("April 20, 2024", "2024-04-20T00:00:00.000Z"),
    ("2024-04-20T15:30:00Z", "2024-04-20T15:30:00.000Z"), ("Sat, 20 Apr 2024 15:30:00 GMT", "2024-04-20T15:30:00.000Z"), ("soon", None), ("", None),
])
def test_publish_date(ev, raw, want):
    assert ev(dates.iso_utc(dates.publish_date(L(raw)))) == want


def test_publish_date_fallback(ev):
    got = ev(dates.publish_date_or(L("soon"), L(datetime(2024, 1, 1))))
    assert got["publish_date_source"] == "fallback"


def test_phones(ev):
    assert ev(phones.sync_digits(L("+1 (512) 555-0100"))) == "5125550100"
    assert ev(phones.format_variants(L("5125550100"))) == ["512-555-0100", "(512) 555-0100", "512.555.0100", "512 555 0100", "5125550100"]
    assert ev(phones.audit_phones(L("id/5125550100 call +1 512 555 0100."))) == ["+1 512 555 0100"]


def test_schema_types(ev):
    assert ev(X.schema_types(L('["A"," B "]'))) == ["A", "B"]
    assert ev(X.schema_types(L("A, B,"))) == ["A", "B"]
    assert ev(X.schema_types(L(None).cast("string"))) == []


def test_replace_first(ev):
    assert ev(X.replace_first(L("a.a"), L("a"), L("b"))) == "b.a"
