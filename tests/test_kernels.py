"""The page kernels: parsing, selecting, extracting, classifying, metadata."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.html import classify as K
from pagemill.html import extract as X
from pagemill.html import metadata as M
from pagemill.html import sanitize as S
from pagemill.html.patterns import alnum_tokens, collapse, token_match
from pagemill.html.select import hits, select, select_first
from pagemill.html.tree import body_of, parse
from pagemill.operators.pages import node_rows

# --------------------------------------------------------------------- parsing


def shape(html):
    return X.serialise(body_of(parse(html)))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p><b>x<br><p>y</b>z", "<p><b>x<br></b></p><p><b>y</b>z</p>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<table>stray<tr><td>x</table>", "stray<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("a < b &amp; c &lt;", "a &lt; b &amp; c &lt;"),
        ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
        ("<a href=1>x<a href=2>y</a>", '<a href="1">x</a><a href="2">y</a>'),
        ("a</p>x", "a<p></p>x"),
        ("<div><p>a</div>b", "<div><p>a</p></div>b"),
    ],
)
def test_tree(html, want):
    assert shape(html) == want


def test_raw_text_and_templates():
    doc = parse('<script>var t="</p>";</script><p>a</p><template><p>b</p></template>')
    assert body_of(doc).content() == "a"
    assert next(n for n in doc.walk() if n.tag == "script").content() == 'var t="</p>";'
    assert parse("<title>a &amp; <b></title>").children[0].children[0].children[0].content() == "a & <b>"


def test_head_and_body():
    doc = parse("<!doctype html><html lang=en><meta charset=x><title>t</title><p>b")
    assert [n.tag for n in doc.elements()] == ["html", "head", "meta", "title", "body", "p"]


tags = st.sampled_from("p div b i a ul li table tr td th h1 h2 span br script style article em dl dd".split())
soup = st.lists(st.one_of(tags.map(lambda t: f"<{t}>"), tags.map(lambda t: f"</{t}>"), st.text("ab <&\"'/", max_size=6), tags.map(lambda t: f'<{t} class="x" onclick=1 href="javascript:1">')), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(soup)
def test_any_soup(html):
    """Never fails; the id ranges of subtrees nest; cleaning holds the floor."""
    rows = node_rows(html)
    for r in rows[1:]:
        p = rows[r["pid"]]
        assert p["nid"] < r["nid"] <= r["last"] <= p["last"] and r["depth"] == p["depth"] + 1
    clean = S.clean_html(html)
    assert S.violations(clean) == []
    assert S.violations(S.clean_html(html, S.Config(allowed_tags=None))) == []
    X.rescue(html, X.extract_tree(parse(html), X.Options()))
    M.metadata(parse(html), "https://x.org/a")
    K.features(K.Facts(parse(html)), None)


def test_depth():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert X.extract_tree(parse(deep), X.Options()).text_length == 0
    assert X.extract_tree(parse("<p>" + "y" * 300 + deep), X.Options()).text_length == 300


# ------------------------------------------------------------------- selectors


def test_selectors():
    doc = parse('<div id=a class="x y"><p data-k="Hello">1<span>2</span></p></div><section><p class="xy">3</p></section>')
    n = lambda s: len(select(doc, s))
    assert [n(s) for s in ("p", "#a", ".x", ".xy", "div p", "div > span", "div > p > span", "[class*='x']", "[data-k='hello' i]", "[data-k='hello']", "p, span, p", "*", "p[", "[class^=x]", "[class$=y]", "[class~=y]")] == [2, 1, 1, 1, 1, 0, 1, 2, 1, 0, 3, 8, 0, 2, 2, 1]
    assert select_first(doc, "p").content() == "12"
    assert len(hits(doc.elements(), "[class*='x'], [class*='y']")) == 4


# ------------------------------------------------------------------------ text


def test_text_facts():
    assert collapse("  a\n\t  b   c ") == "a b c" and collapse(" \n") == ""
    assert token_match("main-sidebar", "sidebar") and token_match("read-more-link", "read-more") and token_match("article-content", "art") is ("art" in alnum_tokens("article-content"))
    assert K.words("one\x85two\x1cthree") == ["one", "two", "three"] and len(K.words("alpha﻿beta")) == 1
    assert K._strip("﻿hi﻿") == "﻿hi﻿"
    assert K.tokenize("Hello, World! a bb") == ["hello", "world", "bb"] and K.tokenize("2025 what") == ["2025", "what"]
    assert K.tfidf("top top news oov", {"top": (0, 2.0), "news": (1, 3.0)}, 2).round(9).tolist() == [0.8, 0.6]


def test_title_and_description():
    f = K.Facts(parse('<title> Hi </title><meta name=description content=" desc ">'))
    assert K.title_and_description(f) == "Hi desc"


# ---------------------------------------------------------------------- forest


def forest(trees):
    return json.dumps({"learner": {"learner_model_param": {"num_class": "2"}, "gradient_booster": {"model": {"tree_info": list(range(len(trees))), "trees": trees}}}})


TREE = {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.5, 1.0, -1.0], "default_left": [1, 0, 0]}
FLIP = TREE | {"split_conditions": [0.5, -1.0, 1.0]}


def test_forest():
    f = K.Forest(forest([TREE, FLIP]))
    p = f.probabilities(np.array([[0.0], [1.0], [0.5], [np.nan]]))
    assert p.argmax(axis=1).tolist() == [0, 1, 1, 0] and np.allclose(p.sum(axis=1), 1)
    for bad in ("{}", "x", forest([TREE | {"left_children": [1]}])):
        with pytest.raises((ValueError, KeyError)):
            K.Forest(bad)


# --------------------------------------------------------------- classification


def refined(html):
    return K.refine("article", K.signals(K.Facts(parse(html))))


def test_refinement():
    ld = lambda t: f'<script type="application/ld+json">{{"@graph":[{{"@type":"{t}"}}]}}</script>'
    assert refined(ld("CollectionPage")) == "collection"
    assert refined(ld("Product")) == "product"
    assert refined('<div class="docs-sidebar"></div><code>a</code><code>b</code><pre>c</pre>') == "documentation"
    assert refined("<p>plain words in a plain article</p>") == "article"
    assert K.refine("forum", K.signals(K.Facts(parse(ld("Product"))))) == "forum"
    assert refined('<meta property="og:type" content="product">') == "product"
    assert refined('<meta property="og:type" content="product.group">') == "collection"
    assert refined("<p>a</p>" + "<a>l</a>" * 9) == "listing"
    cards = '<div class="product-card"></div>' * 5
    assert refined(cards + '<div class="pagination"></div>') == "collection"


def test_url_types():
    for url, want in [("", "article"), ("https://forum.x.org/a", "forum"), ("https://docs.x.org", "documentation"), ("https://x.org/product/1", "product"), ("https://x.org/category/a", "collection"), ("https://x.org/solutions/", "service"), ("https://x.org/reviews/", "listing"), ("https://x.org/blog/a", "article"), (None, "article")]:
        assert K.type_by_url(url) == want
    assert K.domain_path("https://example.com/a/b") == ("example.com", "/a/b")
    assert K.domain_path("https:///") == ("", "/") and K.domain_path("example.com") == ("example.com", "/")


def test_features():
    html = '<title>t</title><body><div class="grid card"><a href="/1">Get started now</a><a href="/1">link</a><a href="/2">link</a><a>link</a></div><p>' + "word " * 10 + "</p><h2>a</h2><img><img></body>"
    x = K.features(K.Facts(parse(html)), "https://shop.x.org/docs/a?b=/c")
    assert x[13] == 1 and x[4] == 1 and x[14] == 1 and x[16] == 1 and x[42] == 2 and x[44] == 1 and x[51] == 2 and x[59] == 2
    assert x[69] == x[80] == 1 and x[79] == 3 and x[72] == 3 and x[40] == 0.4 and x[41] == 10
    assert len(K.feature_vector(K.Facts(parse(html)), None)) == 189


# ------------------------------------------------------------------- extraction

LONG = "This is the text of the article and it goes on for a while. " * 6


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<nav>menu</nav><article><p>{LONG}</p></article><footer>foot</footer>", LONG),
        (f'<div class="post-content"><p>{LONG}</p><div class="sidebar">no</div></div>', LONG),
        (f'<main><p>{LONG}</p><p style="display:none">hidden</p><span aria-hidden="true">x</span></main>', LONG),
        (f"<div><p>{LONG}</p><ul>" + '<li><a href="#">a link</a></li>' * 4 + "</ul></div>", LONG),
    ],
)
def test_extraction(html, text):
    e = X.extract_tree(parse(html), X.Options())
    assert collapse(body_of(parse(e.content_html)).content()) == collapse(text) and e.warnings == []


def test_fallback_and_rescue():
    e = X.extract_tree(parse(f"<article>{'short ' * 20}</article><div><p>{'more text here ' * 8}</p></div>"), X.Options())
    assert e.fallback_used and e.warnings == ["body-fallback-used"]
    assert X.extract_tree(parse("<p>tiny"), X.Options()).warnings == ["content-very-short"]
    body = "Structured words. " * 40
    html = f'<script type="application/ld+json">{json.dumps({"b": [{"articleBody": body}]})}</script><div></div>'
    got = X.rescue(html, X.extract_tree(parse(html), X.Options()))
    assert got.warnings == ["json-ld-rescue"] and got.text_length == len(collapse(body))
    assert X.article_body({"b": {"articlebody": "x"}, "a": {"ARTICLEBODY": "y"}}) == "y"


def test_comments_are_content_in_forums():
    html = f'<div id="posts"><div class="comment"><p>{LONG}</p></div></div>'
    assert X.extract_tree(parse(html), X.Options(page_type="forum")).text_length > 200
    assert X.boilerplate_named(parse('<i class="comments">').children[0].children[1].children[0], X.Options(page_type="forum")) is False


def test_names():
    assert X.boilerplate_token("left-sidebar") and not X.boilerplate_token("my-sidebar") and not X.boilerplate_token("l-sidebar")
    assert not X.boilerplate_token("elementor-widget") and X.boilerplate_token("widget") and not X.boilerplate_token("content")


def test_whitelist_emit():
    html = f'<article><p onclick="x">{LONG}<a href="/a" rel="r">l</a><img src="i" data-x="1"></p></article>'
    o = X.Options(emit="whitelist", include_links=False, include_images=False)
    out = X.extract_tree(parse(html), o).content_html
    assert "<a " not in out and "<img" not in out and "onclick" not in out
    assert 'href="/a"' in X.extract_tree(parse(html), X.Options(emit="whitelist")).content_html


# --------------------------------------------------------------------- metadata


def test_metadata_sources():
    html = """<head><title>A title - Site.org</title><meta property="og:title" content="OG one"><meta property="og:title" content="OG two">
    <meta name="author" content="by jane doe and John Smith"><meta name="keywords" content="a, 'b', , c"><link rel="canonical" href="https://x.org/c#f">
    <meta property="article:published_time" content="2024-03-05T01:02"></head><body><h1>Head</h1><footer><a href="/licenses/by-sa/4.0/">l</a></footer>
    <div class="post-info"><a href="/category/x">Cat</a><a href="/category/x">Cat</a></div></body>"""
    m = M.metadata(parse(html), "https://x.org/q")
    assert m["title"] == "OG two" and m["author"] == "Jane Doe; John Smith" and m["url"] == "https://x.org/c" and m["hostname"] == "x.org"
    assert m["sitename"] == "Site.org" and m["date"] == "2024-03-05" and m["license"] == "CC BY-SA 4.0" and m["categories"] == ["Cat"]
    assert m["tags"] == ["a, b, c"]


def test_json_ld():
    ld = {"@context": "https://schema.org", "@type": "NewsArticle", "headline": "H", "author": [{"@type": "Person", "name": "Ann Lee"}, {"@type": "Organization", "name": "Org"}], "articleSection": ["s", 1], "publisher": {"name": "Pub"}}
    m = M.metadata(parse(f'<script type="application/ld+json">{json.dumps(ld)}</script>'))
    assert (m["title"], m["author"], m["sitename"], m["categories"], m["page_type"]) == ("H", "Ann Lee", "Pub", ["s"], "article")
    broken = '{"@type":"Article","headline":"Broken one","author":{"name":"Bo Ek"},"publisher":{"name":"P"}'
    m = M.metadata(parse(f'<script type="application/ld+json">{broken}</script>'))
    assert m["title"] == "Broken one" and m["author"] == "Bo Ek"


@pytest.mark.parametrize(
    "text, want",
    [("by Jane Doe", "Jane Doe"), ("http://x.org", None), ("a@b.org", None), ("jane doe, JOHN Roe", "Jane Doe; JOHN Roe"), ("Jane Doe @jd 2020", "Jane Doe "), ("Jane; Jane Doe", "Jane Doe"), ("anne-marie o'neil", "Anne-Marie O'Neil"), ("Ann Lee for the News", "Ann Lee")],
)
def test_authors(text, want):
    assert M.normalize_authors(None, text) == want


def test_small_metadata_operators():
    assert M.check_authors("A B; C D", {"c d"}) == "A B" and M.check_authors("A", {"a"}) is None
    assert M.parse_iso("x 2024-02-31") == "2024-02-31" and M.parse_iso("2024-13-01") is None and M.url_date("/2024/03/05/") == "2024-03-05"
    assert M.unescape("&#x41;&amp;lt;&nbsp;&#xD800;") == "A&lt; " and M.line_processing(" \t ") is None
    assert M.valid_url("https://x.org/a") and not M.valid_url("ftp://x") and not M.valid_url("https://")


# ------------------------------------------------------------------- sanitising


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p onclick="x">a</p>', "<p>a</p>"),
        ('<a href="javascript:1">a</a>', "<a>a</a>"),
        ('<a href="java\tscript:1">a</a><a href="/x">b</a>', '<a>a</a><a href="/x">b</a>'),
        ("<script>1</script><iframe srcdoc=x></iframe><object>o</object>b", "b"),
        ("<form>f<input></form>x", "x"),
        ("<article><p>kept</p></article>", "<p>kept</p>"),
        ("<strike>a</strike>", "<del>a</del>"),
        ("", ""),
    ],
)
def test_sanitise(html, want):
    assert S.clean_html(html) == want


def test_documents_and_config():
    out = S.clean_html('<html><head><title>t</title><meta http-equiv=refresh content="0;url=x"></head><body><p>a</p></body></html>')
    assert out.startswith("<!DOCTYPE html>\n<html>") and "http-equiv" not in out
    assert S.clean_html(out) == out
    assert S.config_error({"allowedTags": 1}) and S.config_error({"x": []}).startswith("unknown field 'x'") and S.config_error([]) == "expected a JSON object" and S.config_error({}) is None
    assert S.clean_html("<p><b>a</b><script>x</script></p>", S.Config.of({"allowedTags": ["b", "script"]})) == "<b>a</b>"
    no_images = S.derive(S.DEFAULT, images=False)
    assert S.clean_html("<figure><img src=x><figcaption>c</figcaption></figure>y", no_images) == "y" and S.derive(S.DEFAULT) is S.DEFAULT
    assert S.clean_html('<a href="/x">l</a>', S.derive(S.DEFAULT, links=False)) == "l"
    assert S.clean_html("<table><tr><td>1</table>z", S.derive(S.DEFAULT, tables=False)) == "z"


def test_css():
    assert S.clean_css("a{background:url(javascript:x)}") == "a{background:url('')}"
    assert "expression" not in S.clean_css("width:expression(alert(1))") and "@import" not in S.clean_css("@import 'x';b{}")
    assert S.safe_css_url("//x.org/i.png") and S.safe_css_url("a.png") and not S.safe_css_url("data:x") and not S.safe_css_url("\\6a")


def test_features_of_long_runs_take_linear_time():
    """The pattern of counts tried every end of every run of digits: 40,000 took many seconds."""
    began = time.process_time()
    f = lambda html: K.features(K.Facts(parse(html)), None)
    assert f("1" * 40_000 + " apples of items")[84] == 0 and f("1" * 40_000 + " \n\xa0items")[84] == 1 and f("<p>no 7 item results</p>")[84] == 0
    assert time.process_time() - began < 2


@pytest.mark.parametrize("html, bare, closed", [("a&amp", "a&", "a&amp"), ("&ampx;&amp;amp", "&x;&amp", "&ampx;&amp"), ("&#65;&#65 &lt;&lt&nosuch;", "AA <<&nosuch;", "A&#65 <&lt&nosuch;"), ("&notit;&eacute;", "¬it;é", "&notit;é")])
def test_bare_references(html, bare, closed):
    for page, text in ((f"<p>{html}</p>", lambda d: d.content()), (f"<title>{html}</title>", lambda d: d.content()), (f'<p title="{html}">x</p>', lambda d: body_of(d).children[0].get("title"))):
        assert text(parse(page)) == bare and text(parse(page, bare_references=False)) == closed
