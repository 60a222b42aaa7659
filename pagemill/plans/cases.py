"""Queries over written and generated pages.

The driver's pages hold little of what the page operators look for.  Here are
pages written for one rule each, whose expected results stand in the SQL as the
rules give them, and pages generated from ``page_id``, whose results the SQL
computes from it.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..html import classify as K
from ..html import extract as X
from ..html import metadata as M
from ..html import sanitize as S
from ..html.select import hits, select, select_first
from ..html.tree import Node, body_of, parse
from ..operators import pages as P
from ..sources.pages import bom_encoding, decoded, diagnostics, pages
from .registry import query

_TYPES = {"string": (pa.string(), "VARCHAR"), "long": (pa.int64(), "BIGINT"), "boolean": (pa.bool_(), "BOOLEAN"), "double": (pa.float64(), "DOUBLE")}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def table_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """The rows as a table; every column is cast to its type."""
    cast = ", ".join(f"CAST({c} AS {_TYPES[t][1]}) AS {c}" for c, t in columns.items())
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS v({', '.join(columns)})"


def written(name: str, columns: dict[str, str], rows: list[tuple], one) -> None:
    """Registers a query: ``one(html, param)`` gives a row's values.

    ``rows``: (html, param, expected values ...); ``item`` numbers them.
    """
    columns = {"item": "long", **columns}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(rows)], "item long, html string, param string")
        ddl = ", ".join(f"{c} {t}" for c, t in columns.items() if c != "item")
        out = P._run(P.admitted(df, "html", P.MAX_INPUT, "PERMISSIVE"), ddl, [_TYPES[t][0] for c, t in columns.items() if c != "item"], one, "html", "param")
        return out.select(*columns)

    run.__name__ = name
    query(table_sql(columns, [(k, *r[2:]) for k, r in enumerate(rows)]))(run)


def body(html: str) -> Node:
    return body_of(parse(html))


def first(html: str) -> Node:
    return body(html).element_children()[0]


def text(n: int) -> str:
    """Words of ``n`` characters in all."""
    return ("words of text " * (n // 14 + 1))[: n - 1] + "."


# ------------------------------------------------------------------------- trees

_D = '<div id=a class="x y"><p data-k="Hello">1<span>2</span></p></div><section><p class="xy">3</p></section>'
written(
    "select_cases",
    {"n": "long", "n_of_lists": "long", "first_text": "string"},
    [
        (_D, "p", 2, 2, "12"), (_D, "#a", 1, 1, "12"), (_D, ".x", 1, 1, "12"), (_D, ".xy", 1, 1, "3"), (_D, "div p", 1, 1, "12"), (_D, "div > span", 0, 0, None), (_D, "div > p > span", 1, 1, "2"),
        (_D, "[class*='x']", 2, 2, "12"), (_D, "[data-k='hello' i]", 1, 1, "12"), (_D, "[data-k='hello']", 0, 0, None), (_D, "p, span, p", 3, 5, "12"), (_D, "p[", 0, 0, None),
        (_D, "[class*='x'], [class*='y']", 2, 4, "12"), (_D, "[class^=x]", 2, 2, "12"), (_D, "[class$=y]", 2, 2, "12"), (_D, "[class~=y]", 1, 1, "12"), (_D, "section > .xy, #a", 2, 2, "12"),
    ],
    lambda html, s: [len(select(parse(html), s)), len(hits(parse(html).elements(), s)), n.content() if (n := select_first(parse(html), s)) is not None else None],
)

written(
    "parse_cases",
    {"markup": "string"},
    [
        ("<p>a<p>b", "", "<p>a</p><p>b</p>"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
        ("<table>stray<tr><td>x</table>", "", "stray<table><tbody><tr><td>x</td></tr></tbody></table>"), ("<dl><dt>a<dd>b<dt>c</dl>", "", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("a < b &amp; c &lt;", "", "a &lt; b &amp; c &lt;"), ("a</p>x", "", "a<p></p>x"), ("<div><p>a</div>b", "", "<div><p>a</p></div>b"), ("<h1>a<h2>b</h2>", "", "<h1>a</h1><h2>b</h2>"),
        ("<html><head><title>t</title></head><p>b", "", "<p>b</p>"), ("plain", "", "plain"), ('<p title="a&quot;b">1 &lt; 2</p>', "", '<p title="a&quot;b">1 &lt; 2</p>'),
    ],
    lambda html, _: [X.serialise(body(html))],
)

written(
    "node_facts",
    {"tag": "string", "class": "string", "id": "string", "type": "string", "n_chars": "long", "below": "long", "texts": "string", "title": "string"},
    [
        ('<DIV Class="A b" ID=Main Type="TEXT" title="a&amp;b &lt;c"> x <b>y</b>\n z</DIV>', "", "div", "A b", "Main", "text", 5, 1, "x y z", "a&b <c"),
        ("<p>é&nbsp;漢</p>", "", "p", "", "", "", 3, 0, "é 漢", ""), ("<ul><li>a<li>b<i>c</i></ul>", "", "ul", "", "", "", 3, 3, "a b c", ""),
    ],
    lambda html, _: [(n := first(html)).tag, n.get("class"), n.get("id"), n.get("type").lower(), X.text_len(n), len(n.elements()), M.trim(M._spaced_text(n)), n.get("title")],
)


def _ancestor(html: str, param: str) -> list:
    tag, _, above = param.partition("|")
    root = body(html)
    return [X._inside(next(n for n in root.walk() if n.tag == tag), root, tuple(above.split(",")))]


written(
    "ancestor_cases",
    {"found": "boolean"},
    [(_H := "<article><header><h1><span>x</span></h1></header></article>", "span|article,main", True), (_H, "span|footer", False), (_H, "span|header", True), ("<div><span>x</span></div><p>y</p>", "p|div", False)],
    _ancestor,
)

# ---------------------------------------------------------------------- cleaning


def _cleaned(html: str, param: str) -> list:
    root = body(html)
    focus, _, kind = param.partition("|")
    X.clean(root, X.Options(focus=focus, page_type=kind or "article"))
    return [X.serialise(root)]


written(
    "tree_cleaning",
    {"markup": "string"},
    [
        ("<p>a<!-- c -->b</p>", "balanced", "<p>ab</p>"),
        ('<p>a</p><p style="display:none">b</p><p aria-hidden="true">c</p><div class="noprint"><p>d</p></div><p id="hidden-1">e</p>', "balanced", "<p>a</p>"),
        ('<div style="display: none"><p>only</p></div>', "balanced", '<div style="display: none"><p>only</p></div>'),
        ("<p><abbr>a</abbr><small>b</small><mark>c</mark></p>", "balanced", "<p>abc</p>"),
        ("<p>x</p><nav>n</nav><aside>a</aside><button>b</button><form><p>f</p></form>", "balanced", "<p>x</p>"),
        ("<form><p>f</p></form>", "balanced|forum", "<form><p>f</p></form>"), ("<form><p>f</p></form>", "balanced", ""), ("<form><p>f</p></form>", "recall", "<form><p>f</p></form>"),
        ("<div><p></p><span><b></b></span></div><p>x</p>", "balanced", "<p>x</p>"), ('<figure><img src="i"></figure><p>x</p>', "balanced", '<figure><img src="i"></figure><p>x</p>'),
        ('<div class="related"><p>r</p></div><p>x</p>', "balanced|documentation", "<p>x</p>"), ('<div class="upsells">u</div><p>x</p>', "balanced|product", "<p>x</p>"),
    ],
    _cleaned,
)


def _capped(html: str, most: str) -> list:
    root = body(html)
    X.cap_depth(root, int(most))
    return [X.serialise(root)]


_NEST = "<div>1<div>2<div>3</div></div></div>"
written("depth_cap", {"markup": "string"}, [(_NEST, "2", "<div>1<div></div></div>"), (_NEST, "3", "<div>1<div>2<div></div></div></div>"), (_NEST, "4", _NEST), (_NEST, "0", "")], _capped)

written(
    "hidden_cases",
    {"hidden": "boolean"},
    [
        ('<p style="color:red;display:none">', "", True), ('<p style="visibility: hidden">', "", True), ('<p class="hide-mobile">', "", True), ('<p class="a hide">', "", True), ('<p class="hide">', "", False),
        ('<p class="x-hide-y">', "", True), ('<p id="unhidden">', "", True), ('<p aria-hidden="true">', "", True), ('<p aria-hidden="false">', "", False), ("<p>", "", False), ('<p class="notloaded">', "", True),
    ],
    lambda html, _: [X.is_hidden(first(html))],
)

# ------------------------------------------------------------------ link density

_A = lambda s: f'<a href="u">{s}</a>'
written(
    "link_density_cases",
    {"dense": "boolean", "linked": "boolean"},
    [
        ("<div>abc</div>", "balanced", False, False), (f"<div>{_A(text(120))} x</div>", "balanced", True, False), (f"<div>{_A(text(20))} x</div>", "precision", True, False),
        (f"<div>{_A(text(20))} x</div>", "balanced", True, True), (f"<p>{text(380)} {_A('link')}</p>", "balanced", False, False), ('<div>text<a href="x"></a></div>', "balanced", True, False),
        ("<div>some words here " + " ".join([_A("abc")] * 5) + "</div>", "balanced", True, True), (f"<div>{text(50)} {_A('twelve chars')}</div>", "balanced", False, True),
        (f"<div>{text(250)} {_A('twelve chars')}</div>", "balanced", False, True), (f"<div>{text(250)} {_A('twelve chars')}</div><p>after</p>", "balanced", False, False),
    ],
    lambda html, focus: list(X.link_density(first(html), X.Options(focus=focus))),
)

_TABLE = lambda linked, plain: f"<table><tr><td>{_A(text(linked)) if linked else ''}</td><td>{text(plain) if plain else ''}</td></tr></table>"
written(
    "link_density_tables",
    {"dense": "boolean"},
    [(_TABLE(150, 20), "", False), (_TABLE(270, 30), "", True), (_TABLE(200, 100), "", False), (_TABLE(700, 500), "", True), (_TABLE(500, 700), "", False), (_TABLE(0, 400), "", False), (f"<table><tr><td>{text(300)}<a></a></td></tr></table>", "", True)],
    lambda html, _: [X.link_density_table(first(html))],
)


def _dropped(html: str, param: str) -> list:
    tags, _, back = param.partition("|")
    root = body(html)
    X.drop_by_links(root, X.Options(), tuple(tags.split(",")), bool(back))
    return [X.serialise(root)]


_MENU = f"<ul><li>{_A('one')}</li><li>{_A('two')}</li></ul><p>text</p>"
_THREE = f"<div><p>a</p><p>b</p><p>c {_A('link')}</p></div>"
written(
    "delete_by_link_density",
    {"markup": "string"},
    [(_MENU, "ul,ol", "<p>text</p>"), (_MENU, "ol", _MENU), (f"<h2>{_A('A heading link')}</h2><p>t</p>", "h1,h2", "<p>t</p>"), (_THREE, "div", _THREE), (_THREE, "div|back", ""), ("<div><p>no link</p></div>", "div|back", "<div><p>no link</p></div>")],
    _dropped,
)

# --------------------------------------------------------------------- selection


def _picked(n: Node | None) -> str:
    return "" if n is None else n.get("id") or n.tag


written(
    "rule_picks",
    {"picked": "string", "n_chars": "long"},
    [
        (f'<div class="post-content" id=x>{text(120)}</div>', "", "x", 120), (f'<article id=a>{text(50)}</article><div class="content" id=c>{text(150)}</div>', "", "c", 150), (f"<article id=a>{text(50)}</article>", "", "a", 50),
        ("<p>x</p>", "", "", 0), (f"<section id=primary-x>{text(110)}</section>", "", "primary-x", 110), (f"<main id=m>{text(110)}</main>", "", "m", 110), (f"<div itemprop=articleBody id=i>{text(110)}</div>", "", "i", 110),
        (f'<div class="x PostContent" id=l>{text(110)}</div>', "", "l", 110), (f'<span class="post-content">{text(110)}</span>', "", "", 0), (f'<div class="content" id=c>{text(150)}</div><article id=a>{text(120)}</article>', "", "a", 120),
    ],
    lambda html, _: [_picked((r := X.by_rules(body(html)))[0]), r[1]],
)
written(
    "semantic_picks",
    {"picked": "string"},
    [
        (f"<article id=a>{text(120)}</article><article id=b>{text(150)}</article>", "", "b"), (f"<main id=m>{text(120)}</main>", "", "m"), (f"<div role=main id=r>{text(120)}</div>", "", "r"), ("<article id=a>x</article>", "", ""),
        (f"<article id=a>x</article><main id=m>{text(100)}</main>", "", "m"),
    ],
    lambda html, _: [_picked(X.by_meaning(body(html)))],
)
written(
    "score_picks",
    {"picked": "string"},
    [
        (f"<div id=a><p>{text(100)}</p></div><div id=b><p>{text(200)}</p></div>", "", "b"), (f"{text(600)}<div id=b><p>{text(200)}</p></div>", "", ""), ("<div id=a>no paragraph</div>", "", ""),
        (f"<div id=a><p>{_A(text(150))}</p></div><div id=b><p>{text(110)}</p></div>", "", "b"), (f"<table><tr><td id=c><p>{text(90)}</p></td></tr></table>", "", "c"),
    ],
    lambda html, _: [_picked(X.by_score(body(html), X.Options()))],
)
written(
    "profile_picks",
    {"picked": "string"},
    [
        (_F := f"<div id=posts>{text(120)}</div><article id=a>{text(200)}</article>", "forum", "posts"), (_F, "article", "a"), (f'<div class="product-description" id=d>{text(120)}</div><article id=a>{text(200)}</article>', "product", "d"),
        (f'<div class="markdown" id=d>{text(120)}</div><article id=a>{text(200)}</article>', "documentation", "d"), (f'<div class="markdown" id=d>{text(90)}</div><article id=a>{text(200)}</article>', "documentation", "a"), ("<p>x</p>", "article", "body"),
        (f"<div id=s><p>{text(150)}</p></div>", "service", "s"), (f"<article id=w>{text(60)}</article>", "listing", "w"),
    ],
    lambda html, kind: [_picked(X.choose(body(html), X.Options(page_type=kind)))],
)

# ------------------------------------------------------------------------- names

written(
    "token_verdicts",
    {"boilerplate": "boolean", "parts": "long"},
    [
        ("left-sidebar", "", True, 2), ("my-sidebar", "", False, 2), ("sidebar_x", "", True, 2), ("l-sidebar", "", False, 2), ("elementor-widget", "", False, 2), ("widget", "", True, 1), ("content", "", False, 1),
        ("nav", "", True, 1), ("c-social", "", False, 2), ("c-social-nav", "", True, 3), ("read-more-x", "", True, 3), ("canvas", "", False, 1), ("advert", "", True, 1), ("navigation_bar", "", True, 2), ("l-nav", "", True, 2),
    ],
    lambda token, _: [X.boilerplate_token(token), len(X.hyphen_parts(token))],
)
written(
    "named_elements",
    {"always": "boolean", "by_name": "boolean"},
    [
        ('<div class="wp-caption-text">', "article", True, True), ('<div itemtype="https://schema.org/BreadcrumbList">', "article", True, True), ('<div class="comments">', "article", False, True), ('<div class="comments">', "forum", False, False),
        ('<div class="comment-container">', "article", True, True), ('<div class="comment-container">', "forum", False, False), ('<div id="newsletter">', "article", False, True), ('<div class="text">', "article", False, False), ("<div>", "article", False, False),
        ('<div class="Post-Meta-Infos">', "article", True, True), ('<div class="body" id="left-sidebar">', "forum", False, True),
    ],
    lambda html, kind: [X.always_excluded(first(html), X.Options(page_type=kind)), X.boilerplate_named(first(html), X.Options(page_type=kind))],
)
written(
    "pruning_passes",
    {"markup": "string", "n_chars": "long"},
    [
        ("<header>h</header><p>text</p><footer>f</footer>", "gated", "<p>text</p>", 4), ("<article><header>h</header><p>t</p></article>", "gated", "<article><header>h</header><p>t</p></article>", 2),
        ('<div class="share">s</div><p>t</p>', "gated", "<p>t</p>", 1), ('<div class="share">s</div><p>t</p>', "always", '<div class="share">s</div><p>t</p>', 2), ('<div class="read-more-link">s</div><p>t</p>', "always", "<p>t</p>", 1),
        (_MENU, "gated", "<p>text</p>", 4), ("<p></p>", "gated", "", 0),
    ],
    lambda html, which: list(X._render(body(html), X.Options(), which == "gated")),
)

# -------------------------------------------------------------------- extraction

_W, _SHORT = text(300), "short " * 20
_BODY = ("Structured words. " * 40).strip()
_EXTRACTS = [
    (f"<nav>menu</nav><article><p>{_W}</p></article><footer>foot</footer>", None, "article", 300, False, "", f"<article><p>{_W}</p></article>"),
    ("<p>tiny", None, "article", 4, False, "content-very-short", "<p>tiny</p>"),
    (f"<article>{_SHORT}</article><div><p>{'more text here ' * 8}</p></div>", None, "article", 239, True, "body-fallback-used", f"<article>{_SHORT}</article><div><p>{'more text here ' * 8}</p></div>"),
    (f'<script type="application/ld+json">{json.dumps({"b": [{"articleBody": _BODY}]})}</script><div></div>', None, "article", 719, True, "json-ld-rescue", f"<p>{_BODY}</p>"),
    (f"<form><p>{text(250)}</p></form>", None, "article", 250, True, "baseline-rescue", f"<p>{text(250)}</p>"),
    (f"<div id=posts><div class=comment><p>{_W}</p></div></div>", "https://forum.x.org/t/1", "forum", 300, False, "", f'<div id="posts"><div class="comment"><p>{_W}</p></div></div>'),
    (f"<main><p>{_W}</p><p style='display:none'>hidden</p></main>", None, "article", 300, False, "", f"<main><p>{_W}</p></main>"),
    (f'<div class="post-content"><p>{_W}</p><div class="sidebar">no</div></div>', None, "article", 300, False, "", f'<div class="post-content"><p>{_W}</p></div>'),
    ("", None, "article", 0, False, "", ""),
]
_EXTRACT = {"item": "long", "page_type": "string", "n_chars": "long", "fallback": "boolean", "warnings": "string", "markup": "string"}


@query(table_sql(_EXTRACT, [(k, *r[2:]) for k, r in enumerate(_EXTRACTS)]))
def extract_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection, fallback to the body, and rescues, on written pages."""
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(_EXTRACTS)], "item long, html string, url string")
    e = P.extract_pages(df)
    return e.select("item", "page_type", F.col("text_length").alias("n_chars"), F.col("fallback_used").alias("fallback"), F.array_join("warnings", ",").alias("warnings"), F.col("content_html").alias("markup"))


written(
    "article_bodies",
    {"found": "string"},
    [
        ('{"b":{"articlebody":"x"},"a":{"ARTICLEBODY":"y"}}', "", "y"), ('{"@graph":[{"n":1},{"articleBody":"z"}]}', "", "z"), ('{"articleBody":5}', "", None), ('[[{"x":[{"articleBody":"deep"}]}]]', "", "deep"), ('{"articleBody":"a","b":{"articleBody":"b"}}', "", "a"),
    ],
    lambda raw, _: [X.article_body(json.loads(raw))],
)
written(
    "baseline_cases",
    {"found": "string"},
    [
        ("<aside>a</aside><p>one</p><p>one</p><blockquote>two</blockquote>", "", "one|two"), ('<div class="cookie-bar"><p>x</p></div><p>y</p>', "", "y"), ("<p>We use cookie consent</p><p>z</p>", "", "z"), (f"<article>{text(150)}</article><p>x</p>", "", text(150)),
        ("<div>plain</div>", "", "plain"), ('<div id="footer"><p>f</p></div><p>k</p>', "", "k"), ('<div class="share-box"><p>s</p></div><p>k</p>', "", "k"), ("<article>short</article><pre>code</pre>", "", "code"), ("<nav>n</nav>", "", ""),
    ],
    lambda html, _: ["|".join(X.baseline_paragraphs(parse(html)))],
)
_MARK = '<p onclick="x" class="c">a<a href="/a" rel="r">l</a><img src="i" data-x="1"><script>s</script><custom>k</custom></p>'
written(
    "serialised",
    {"markup": "string"},
    [
        (_MARK, "preserve", '<p onclick="x" class="c">a<a href="/a" rel="r">l</a><img src="i" data-x="1"><custom>k</custom></p>'), (_MARK, "whitelist", '<p>a<a href="/a">l</a><img src="i">k</p>'), (_MARK, "whitelist bare", "<p>alk</p>"),
        ('<p title="a&quot;b">1 &lt; 2 &amp; 3</p>', "preserve", '<p title="a&quot;b">1 &lt; 2 &amp; 3</p>'), ("<table><tr>" + "<td>" * 20_001 + "</table>", "preserve", "<table></table>"), ("<aside>a</aside><b>b</b><noscript>n</noscript>", "whitelist", "<b>b</b>"),
        ('<td colspan="2">x</td><blockquote cite="u" class="q">y</blockquote>', "whitelist", 'x<blockquote cite="u">y</blockquote>'),
    ],
    lambda html, how: [X.serialise(body(html), X.Options(emit=how.split()[0], include_links="bare" not in how, include_images="bare" not in how))],
)

# ---------------------------------------------------------------- classification

_LD = lambda v: f'<script type="application/ld+json">{json.dumps(v)}</script>'
_T = lambda *types: _LD({"@graph": [{"@type": t} for t in types]})
_CARDS = '<div class="product-card"></div>' * 5
written(
    "refine_cases",
    {"page_type": "string"},
    [
        (_T("CollectionPage"), "article", "collection"), (_T("OfferCatalog"), "article", "collection"), (_T("Product"), "article", "product"), (_T("ProductGroup"), "article", "product"), (_T("Product", "AggregateOffer"), "article", "collection"),
        (_T("ItemList"), "article", "article"), (_T("ItemList") + _CARDS, "article", "collection"), ('<meta property="og:type" content="product.group">', "article", "collection"), ('<meta property="og:type" content="PRODUCT">', "article", "product"),
        ('<meta property="og:type" content="product"><div class="product-grid"></div>', "article", "collection"), (_CARDS, "article", "article"), (_CARDS + '<div class="pagination"></div>', "article", "collection"),
        (_CARDS + "<button>Add to cart</button>", "article", "collection"), ('<div id="products-grid"></div><a>Buy now</a>', "article", "collection"), ('<div class="docs-sidebar"></div><code>a</code><code>b</code><pre>c</pre>', "article", "documentation"),
        ('<div class="docs-sidebar"></div><code>a</code><code>b</code>', "article", "article"), ("<code></code>" * 500, "article", "documentation"), ("<p>a</p>" + "<a>l</a>" * 3, "article", "listing"), ("<p>a</p>" + "<a>l</a>" * 2, "article", "article"),
        ("<p>plain words in a plain article</p>", "article", "article"), (_T("Product"), "forum", "forum"), ("<template>" + _CARDS + '<div class="pagination"></div></template>', "article", "article"),
    ],
    lambda html, kind: [K.refine(kind, K.signals(K.Facts(parse(html))))],
)
written(
    "ld_type_cases",
    {"types": "string"},
    [
        (_LD({"@type": "A", "b": [{"@type": ["B", "C", 1]}]}), "", "A,B,C"), (_LD({"z": {"@type": "Z"}, "a": {"@type": "Y"}}), "", "Y,Z"), ('<script type="application/ld+json">broken{</script>' + _LD({"@type": "D"}), "", "D"),
        ('<script type="text/json">{"@type":"E"}</script>', "", ""), ("<p>", "", ""),
    ],
    lambda html, _: [",".join(K.signals(K.Facts(parse(html)))["ld_types"])],
)
written(
    "title_meta_text",
    {"text": "string", "og_type": "string", "tokens": "string"},
    [
        ('<title> Hi </title><meta name=description content=" desc ">', "", "Hi desc", "", "hi desc"), ('<title>A b c1</title><meta property="og:description" content="D"><meta property="OG:TYPE" content="Article">', "", "A b c1 D", "article", "c1"),
        ('<meta name="excerpt" content="ex"><meta name="description" content="">', "", "ex", "", "ex"), ('<meta name="description" content="one"><meta name="description" content="two">', "", "one", "", "one"), ("<p>x", "", "", "", ""),
    ],
    lambda html, _: [t := K.title_and_description(K.Facts(parse(html))), K.Facts(parse(html)).og_type, " ".join(K.tokenize(t))],
)


def _tree(leaf: float) -> dict:
    return {"left_children": [-1], "right_children": [-1], "split_indices": [0], "split_conditions": [leaf], "default_left": [0]}


def _split(low: float, high: float) -> dict:
    return {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.5, low, high], "default_left": [1, 0, 0]}


def forest_json(trees: list[dict], classes: int) -> str:
    return json.dumps({"learner": {"learner_model_param": {"num_class": str(classes)}, "gradient_booster": {"model": {"tree_info": list(range(len(trees))), "trees": trees}}}})


def _voted(_: str, value: str) -> list:
    import numpy as np

    try:
        forest = K.Forest(forest_json([_split(1.0, -1.0), _split(-1.0, 1.0)], 2) if value != "broken" else forest_json([_split(1.0, -1.0) | {"left_children": [1]}], 1))
    except ValueError:
        return [None, None]
    p = forest.probabilities(np.array([[float(value)]]))[0]
    return [int(p.argmax()), round(float(p.max()), 6)]


# one leaf of 1 against one of -1: e / (e + 1/e)
written("forest_cases", {"label": "long", "p": "double"}, [("", "0.0", 0, 0.880797), ("", "1.0", 1, 0.880797), ("", "0.5", 1, 0.880797), ("", "nan", 0, 0.880797), ("", "broken", None, None)], _voted)


def _cascade(html: str, param: str) -> list:
    url, _, label = param.partition("|")
    labels = K.page_model()["labels"]
    forest = K.Forest(forest_json([_tree(2.0 if name == label else 0.0) for name in labels], len(labels)))
    kind, confidence = K.classify(parse(html), url, forest)
    return [kind, round(confidence, 6)]


_P = round(math.e**2 / (math.e**2 + 6), 6)  # the forest's own share
written(
    "cascade_cases",
    {"page_type": "string", "confidence": "double"},
    [
        ("<p>x</p>", "https://forum.x.org/a|forum", "forum", 1.0), ("<p>x</p>", "https://forum.x.org/a|service", "service", _P), (_T("Product"), "https://x.org/a|product", "product", 0.95), (_T("Product"), "https://x.org/a|listing", "listing", _P),
        ("<p>x</p>", "https://x.org/a|article", "article", _P),
    ],
    _cascade,
)

# ---------------------------------------------------------------------- cleaning

_DOC = '<html><head><title>t</title><meta http-equiv=refresh content="0;url=x"></head><body><p>a</p></body></html>'


def _sanitised(html: str, param: str) -> list:
    o = json.loads(param) if param else {}
    rules = S.derive(S.Config.of(o["config"]) if "config" in o else S.DEFAULT, o.get("images"), o.get("tables"), o.get("links"))
    out = S.clean_html(html, rules, bool(o.get("minify")))
    return [out, len(S.violations(html)), len(S.violations(out))]


written(
    "sanitise_cases",
    {"markup": "string", "before": "long", "after": "long"},
    [
        ('<p onclick="x">a</p>', "", "<p>a</p>", 1, 0), ('<a href="javascript:1">a</a>', "", "<a>a</a>", 1, 0), ('<a href="java\tscript:1">a</a><a href="/x">b</a>', "", '<a>a</a><a href="/x">b</a>', 1, 0),
        ("<script>1</script><iframe srcdoc=x></iframe><object>o</object>b", "", "b", 4, 0), ("<article><p>kept</p></article>", "", "<p>kept</p>", 0, 0), ("<strike>a</strike>", "", "<del>a</del>", 0, 0), ("", "", "", 0, 0), ("  ", "", "", 0, 0),
        (_DOC, "", "<!DOCTYPE html>\n<html><head><title>t</title></head><body><p>a</p></body></html>", 1, 0), ("<p><b>a</b><script>x</script></p>", '{"config": {"allowedTags": ["b", "script"]}}', "<b>a</b>", 1, 0),
        ("<figure><img src=x><figcaption>c</figcaption></figure>y", '{"images": false}', "y", 0, 0), ('<a href="/x">l</a>', '{"links": false}', "l", 0, 0), ("<table><tr><td>1</table>z", '{"tables": false}', "z", 0, 0),
        ('<img src="/i.png" onerror="x" class="c" alt="a&quot;b">', "", '<img src="/i.png" alt="a&quot;b">', 1, 0), ("<p>a  b</p>\n\n<p>c</p>", '{"minify": true}', "<p>a b</p> <p>c</p>", 0, 0),
        ('<a href="data:text/html,x">d</a><a href="mailto:a@b.c">m</a>', "", '<a>d</a><a href="mailto:a@b.c">m</a>', 1, 0), ('<code class="language-py" id="z">x</code>', "", '<code class="language-py">x</code>', 0, 0),
        ('<p class="a b c">x</p>', '{"config": {"allowedTags": ["p"], "allowedAttributes": {"p": ["id"]}, "allowedClasses": {"p": ["b"]}}}', '<p class="b">x</p>', 0, 0),
    ],
    _sanitised,
)
def _hardened(html: str, param: str) -> list:
    rules = S.Config.of(json.loads(param)) if param else S.DEFAULT
    return [out := S.clean_html(html, rules, hardened=True), len(S.violations(out))]


_P_ONLY = '{"allowedTags": ["p", "a"], "allowedAttributes": {"a": ["href", "onclick"], "p": ["title", "data-k"]}}'
written(
    "hardened_cases",
    {"markup": "string", "after": "long"},
    [
        ('<p onclick="x" title="t">a</p>', "", '<p title="t">a</p>', 0), ('<a href="javascript:1">a</a><a href="/x">b</a><a href="ftp://h">c</a>', "", '<a>a</a><a href="/x">b</a><a href="ftp://h">c</a>', 0), ("<script>1</script><style>s</style><svg><b>v</b></svg>x", "", "x", 0),
        ("<article><p>kept</p></article><!-- c -->", "", "<p>kept</p>", 0), ('<p href="/h" title="t" aria-label="l" data-k="d">a</p>', _P_ONLY, '<p href="/h" title="t" aria-label="l" data-k="d">a</p>', 0), ('<a onclick="x" href="custom:y">a</a>', _P_ONLY, "<a>a</a>", 0),
        ("<strike>a</strike><textarea>t</textarea>", "", "<del>a</del>t", 0), ("<p>a</p>", "{}", "a", 0), ("<noscript>n</noscript><table><thead><tr><td>h</td></tr></thead></table>", "", "<table></table>", 0),
        ("<html><head><title>t</title></head><body><p>a</p></body></html>", "", "<!DOCTYPE html>\n<html><head><title>t</title></head><body><p>a</p></body></html>", 0), ("<html><body><p>a</p></body></html>", _P_ONLY, "<p>a</p>", 0), (" ", "", "", 0),
        ('<img src="data:image/png;base64,x" alt="javascript:x">', "", '<img alt="javascript:x">', 0), ('<p title="java script:x">a</p><a href="java\tscript:x">b</a>', "", '<p title="java script:x">a</p><a>b</a>', 0),
    ],
    _hardened,
)
written(
    "css_cases",
    {"css": "string", "safe": "boolean"},
    [
        ("a{background:url(javascript:x)}", "javascript:x", "a{background:url('')}", False), ("a{background:url(/i.png)}", "/i.png", "a{background:url(/i.png)}", True), ("@import 'x';b{}", "//x.org/i.png", "b{}", True), ("width:expression(alert(1))", "data:x", "width:", False),
        ("a/* c */b", "\\6a", "a b", False), ("x{-moz-binding:url(y);color:red}", "https://x.org/a", "x{color:red}", True), ("u:url('data:x')", "a.png", "u:url('')", True), ("p{}", " ", "p{}", False),
    ],
    lambda css, url: [S.clean_css(css), S.safe_css_url(url)],
)
written(
    "config_cases",
    {"reason": "string"},
    [
        ("{}", "", None), ("[]", "", "expected a JSON object"), ('{"allowedTags": 1}', "", "'allowedTags' must be an array of strings"), ('{"allowedTags": ["p", 1]}', "", "'allowedTags' must be an array of strings"),
        ('{"allowedAttributes": {"p": "id"}}', "", "'allowedAttributes' must map tag names to arrays of strings"), ('{"transformTags": {"b": 1}}', "", "'transformTags' must map tag names to tag-name strings"), ('{"allowedTags": ["p"], "transformTags": {"b": "i"}}', "", None),
        ('{"nonTextTags": "x"}', "", "'nonTextTags' must be an array of strings"), ('{"selfClosing": {}}', "", "'selfClosing' must be an array of strings"),
    ],
    lambda raw, _: [S.config_error(json.loads(raw))],
)


def _option_error(html: str, raw: str) -> list:
    o = {"boilerplate": "balanced", "page_type": None} | json.loads(raw)
    try:
        P.check_options(**o)
    except (TypeError, ValueError) as e:
        return [type(e).__name__]
    return [None]


written(
    "option_guards",
    {"reason": "string"},
    [
        ("", "{}", None), ("", '{"boilerplate": "keep"}', None), ("", '{"boilerplate": "all"}', "ValueError"), ("", '{"page_type": "forum"}', None), ("", '{"page_type": "category"}', "ValueError"), ("", '{"include_links": "no"}', "TypeError"),
        ("", '{"include_images": false}', None), ("", '{"include_tables": 1}', "TypeError"),
    ],
    _option_error,
)

# ---------------------------------------------------------------------- metadata

_META = {f: "string" for f in ("title", "author", "url", "hostname", "description", "sitename", "date", "categories", "tags", "image", "page_type", "license")}


def _metadata(html: str, param: str) -> list:
    url, _, blacklist = param.partition("|")
    m = M.metadata(parse(html), url or None, set(blacklist.split(",")) if blacklist else None)
    return [", ".join(v) if isinstance(v := m.get(f), list) else v for f in _META]


def _fields(html: str, param: str = "", **want) -> tuple:
    return (html, param, *(want.get(f) for f in _META))


_OG = lambda **kv: "<head>" + "".join(f'<meta property="og:{k}" content="{v}">' for k, v in kv.items()) + "</head>"
_NAMED = lambda **kv: "<head>" + "".join(f'<meta name="{k}" content="{v}">' for k, v in kv.items()) + "</head>"
_ARTICLE = lambda **kv: _LD({"@context": "https://schema.org", "@type": "NewsArticle", **kv})
written(
    "metadata_cases",
    _META,
    [
        _fields(_OG(title="T", description="D", site_name="S", image="/i.png", url="https://x.org/p"), title="T", description="D", sitename="S", image="/i.png", url="https://x.org/p", hostname="x.org"),
        _fields(_OG(url="no url", title=" "), "https://a.b/c", url="https://a.b/c", hostname="a.b", sitename="a.b"),
        _fields(_NAMED(author="by jane doe and John Smith", description="D", keywords="a, 'b'", title="N"), title="N", author="Jane Doe; John Smith", description="D", tags="a, b"),
        _fields(_NAMED(author="Single"), ""),
        _fields(_NAMED(publisher="the paper"), sitename="The Paper"),
        _fields('<head><meta name="application-name" content="@App"></head>', sitename="App"),
        _fields("<h1>Head</h1><p>x", title="Head"),
        _fields("<title>One - Two</title>", title="One"),
        _fields("<title>Story | news.org</title><h1>a</h1><h1>b</h1>", title="Story", sitename="news.org"),
        _fields("<h2>Second</h2>", title="Second"),
        _fields('<h1>a</h1><h1 class="page-title">The title</h1>', title="The title"),
        _fields('<div class="author">Jane Doe</div>', author="Jane Doe"),
        _fields('<div class="author">Jane Doe</div>', "|jane doe"),
        _fields('<div id="comments"><span class="author">Ann Lee</span></div><p class="byline">By Bo Ek</p>', author="Bo Ek"),
        _fields('<head><link rel="canonical" href="https://x.org/c#f"></head>', "https://y.org", url="https://x.org/c", hostname="x.org", sitename="x.org"),
        _fields('<head><link rel="canonical" href="/c"><meta property="og:image" content="https://x.org/i.png"></head>', url="https://x.org/c", hostname="x.org", sitename="x.org", image="https://x.org/i.png"),
        _fields("<p>x", "https://www.x.org/2024/03/05/a", url="https://www.x.org/2024/03/05/a", hostname="x.org", sitename="x.org", date="2024-03-05"),
        _fields('<time datetime="2023-01-02T03:04">x</time>', date="2023-01-02"),
        _fields('<head><meta property="article:published_time" content="2022-05-06"></head><time datetime="2023-01-02">x</time>', date="2022-05-06"),
        _fields(_LD({"datePublished": "2021-07-08T00:00"}), date="2021-07-08"),
        _fields('<footer><a href="https://creativecommons.org/licenses/by-sa/4.0/">x</a></footer>', license="CC BY-SA 4.0"),
        _fields('<a rel="license" href="/own">Own terms</a>', license="Own terms"),
        _fields('<div class="post-info"><a href="/category/x">Cat</a><a href="/category/y">Cat</a><a href="/other">O</a></div>', categories="Cat"),
        _fields('<div class="tags"><a href="/tag/x">t1</a><a href="/tags/y">t2</a></div>', tags="t1, t2"),
        _fields('<head><meta property="article:section" content="World"></head>', categories="World"),
        _fields(_ARTICLE(headline="H", author=[{"@type": "Person", "name": "Ann Lee"}, {"@type": "Organization", "name": "Org"}], articleSection=["s", 1], publisher={"name": "Pub"}), title="H", author="Ann Lee", sitename="Pub", categories="s", page_type="article"),
        _fields(_ARTICLE(author="Bo Ek", articleSection="one"), author="Bo Ek", categories="one", page_type="article"),
        _fields(_ARTICLE(author={"@type": "Person", "givenName": "Cy", "familyName": "Dee"}), author="Cy Dee", page_type="article"),
        _fields(_LD({"@context": "https://schema.org", "@graph": [{"@type": "WebSite", "name": "Site name"}, {"@type": "Person", "name": "Eve Fox"}]}), author="Eve Fox", sitename="Site name", page_type="article"),
        _fields('<script type="application/ld+json">{"@type":"Article","headline":"Broken one","author":{"name":"Bo Ek"},"publisher":{"name":"P"}</script>', title="Broken one", author="Bo Ek", sitename="P", page_type="article"),
        _fields(_LD({"@context": "https://other.org", "@type": "Article", "headline": "no"})),
        _fields("<p>nothing"),
    ],
    _metadata,
)
written(
    "author_cases",
    {"author": "string"},
    [
        ("by Jane Doe", "", "Jane Doe"), ("http://x.org", "", None), ("a@b.org", "", None), ("jane doe, JOHN Roe", "", "Jane Doe; JOHN Roe"), ("Jane; Jane Doe", "", "Jane Doe"), ("anne-marie o'neil", "", "Anne-Marie O'Neil"), ("Ann Lee for the News", "", "Ann Lee"),
        ("Jane Doe", "Ann Lee", "Ann Lee; Jane Doe"), ("<b>Bo Ek</b>", "", "Bo Ek"), ("a@b.org", "Ann Lee", "Ann Lee"),
    ],
    lambda s, current: [M.normalize_authors(current or None, s)],
)
written(
    "author_blacklist",
    {"author": "string"},
    [("A B; C D", "c d", "A B"), ("A", "a", None), ("A B; C D", "x", "A B; C D"), (" ; A B", "x", "A B")],
    lambda s, low: [M.check_authors(s, {low})],
)
written(
    "small_metadata",
    {"unescaped": "string", "normal": "string", "trimmed": "string", "valid": "boolean"},
    [
        ("&#x41;&amp;lt;&nbsp;&#xD800;", "https://x.org/a", "A&lt; ", "&#x41;&amp;lt;&nbsp;&#xD800;", "&#x41;&amp;lt;&nbsp;&#xD800;", True), ("a\\nb \\u0041 <b>c</b>", "ftp://x", "a\\nb \\u0041 <b>c</b>", "ab A c", "a\\nb \\u0041 <b>c</b>", False),
        ("  a \t b ", "https://", "  a \t b ", "a b", "a b", False), ("&#65;", "http://a b", "A", "&#65;", "&#65;", False),
    ],
    lambda s, url: [M.unescape(s), M.normalize_json(s), M.trim(s), M.valid_url(url)],
)

# ------------------------------------------------------- native columns, sources


@query(table_sql({"s": "string", "page_type": "string"}, [("Category", "collection"), ("category", "collection"), ("docs", "documentation"), ("DOCUMENTATION", "documentation"), ("forum", "forum"), ("blog", None), ("", None)]))
def page_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in ("Category", "category", "docs", "DOCUMENTATION", "forum", "blog", "")], "s string").select("s", T.page_type_alias(F.col("s")).alias("page_type"))


_MARKS = {"utf-8": ("EFBBBF", "UTF-8"), "utf-16-le": ("FFFE", "UTF-16LE"), "utf-16-be": ("FEFF", "UTF-16BE"), None: ("", "UTF-8")}


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' WHEN 2 THEN 'utf-16-be' END AS mark, md5(html) AS html, CAST(0 AS BIGINT) AS messages FROM pages")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as bytes of one of four encodings, and back."""
    k, html = F.col("page_id") % 4, F.col("html")
    content = F.lit(None).cast("binary")
    for n, (mark, name) in enumerate(_MARKS.values()):
        content = F.when(k == n, F.concat(F.unhex(F.lit(mark)), F.encode(html, name))).otherwise(content)
    rows = pages(spark, sf_dir).select("page_id", content.alias("content"))
    out = decoded(rows.withColumn("mark", bom_encoding(F.col("content"))), "content")
    return out.select("page_id", "mark", F.md5(F.col("html")).alias("html"), F.size("messages").cast("long").alias("messages"))


@query("SELECT page_id, '<p>' || page_id || '</p>' AS html, CAST(1 + (page_id + 1) % 2 AS BIGINT) AS messages, page_id % 2 = 0 AS guessed FROM pages")
def cleaned_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in, clean pages out: what decoding says comes before what
    cleaning says."""
    text = F.concat(F.lit("<p>"), "page_id", F.when(F.col("page_id") % 2 == 0, F.lit("</p><i>é</i>")).otherwise(F.lit("</p>")))
    mark = F.when(F.col("page_id") % 4 == 1, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    out = P.clean_bytes(pages(spark, sf_dir).select("page_id", F.concat(mark, F.encode(text, "ISO-8859-1")).alias("content")), url_col=None)
    html = F.regexp_replace("html", "<i>.*", "")
    return out.select("page_id", html.alias("html"), F.size("messages").cast("long").alias("messages"), F.exists("messages", lambda m: m["text"].contains("decoded as")).alias("guessed"))


@query("SELECT page_id, md5(url || '<p>' || page_id || '</p>') AS html, page_id % 3 = 0 AS warned FROM pages")
def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean results as JSON text and back, with their messages."""
    kind = "struct<html:string,messages:array<struct<type:string,text:string>>,metadata:struct<title:string>,page_type:string,confidence:double>"
    html = F.concat("url", F.lit("<p>"), "page_id", F.lit("</p>"))
    messages = F.when(F.col("page_id") % 3 == 0, F.array(F.struct(F.lit("warning").alias("type"), F.lit('a "quoted" text').alias("text")))).otherwise(F.expr("array()"))
    rows = pages(spark, sf_dir).select("page_id", html.alias("html"), messages.cast(kind[kind.index("array") : kind.index(",metadata")]).alias("messages"), F.struct(F.col("url").alias("title")).alias("metadata"), F.lit("article").alias("page_type"), F.lit(None).cast("double").alias("confidence"))
    back = rows.select("page_id", P.parse_result(P.result_json(rows)).alias("r"))
    return back.select("page_id", F.md5("r.html").alias("html"), (F.size("r.messages") > 0).alias("warned"))


@query("SELECT 'warning' AS type, 'boilerplate: content-very-short' AS text, count(*) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'warning', 'boilerplate removal produced no content; cleaning the whole document', count(*) FROM pages WHERE page_id % 3 = 1")
def generated_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each message is given: pages of a short text, none, a long one."""
    html = F.when(F.col("page_id") % 3 == 0, "<p>tiny</p>").when(F.col("page_id") % 3 == 1, "<nav>menu</nav>").otherwise(f"<article><p>{text(300)}</p></article>")
    return diagnostics(P.clean_pages(pages(spark, sf_dir).select("page_id", html.alias("html")), url_col=None))


# --------------------------------------------------------------- generated pages


def _generated(spark: SparkSession, sf_dir: str, parts: list[tuple[str, str]], tail: str = "") -> DataFrame:
    """Pages of fragments, each repeated as often as an expression of ``k``
    (the page's id) says.  Ids are dealt out first: they are small, and the
    pages made of them are not, however few files or row groups they come from."""
    rows = pages(spark, sf_dir).select("page_id").repartition(4 * spark.sparkContext.defaultParallelism).select("page_id", F.col("page_id").alias("k"))
    html = F.concat(*(F.expr(f"repeat({_sql_text(s)}, cast({n} AS int))") for s, n in parts), F.lit(tail))
    return rows.select("page_id", html.alias("html"), F.lit(None).cast("string").alias("url"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def generated_features(name: str, parts: list[tuple[str, str]], want: dict[int, str], digits: int = 9) -> None:
    """Registers a query of features over generated pages, by what the SQL
    computes from the numbers of fragments."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = P.page_features(_generated(spark, sf_dir, parts), only=("page_id", "features"))
        return x.select("page_id", *(F.round(F.get("features", F.lit(f)), digits).alias(f"f{f:02d}") for f in want))

    run.__name__ = name
    cols = ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) AS f{f:02d}" for f, e in want.items())
    query(f"SELECT page_id, {cols} FROM (SELECT page_id, page_id AS k FROM pages)")(run)


_LONG_P, _SHORT_P = "twenty-five letters of text", "short"
_N_WORDS = "(CASE WHEN k % 4 > 0 THEN 3 * (k % 4) + 1 WHEN k % 3 > 0 THEN 1 ELSE 0 END)"
_SIZE = "(27 * (k % 4) + 5 * (k % 3) + (k % 2 + 1) + (k % 5) + (k % 5) + 6)"
generated_features(
    "text_features",
    [("<body>", "1"), (f"<p>{_LONG_P}</p>", "k % 4"), (f"<p>{_SHORT_P}</p>", "k % 3"), ("<h2>x</h2>", "k % 2 + 1"), ("<h3>y</h3>", "k % 5"), ('<a href="/u">z</a>', "k % 5"), ("<img>", "k % 3"), ("$€£", "1")],
    {
        14: "k % 4", 15: "CASE WHEN k % 4 > 0 THEN 27 ELSE 0 END", 16: "k % 2 + 1 + k % 5", 17: f"{_SIZE} / (k % 2 + 1)", 40: f"CASE WHEN {_N_WORDS} > 0 THEN (k % 5) / {_N_WORDS} ELSE 0 END", 41: _N_WORDS, 51: "k % 3", 58: _SIZE,
        59: "CASE WHEN k % 5 > 0 THEN 1 ELSE 0 END", 65: "3", 66: f"(k % 3) / ({_SIZE} / 1000)", 67: "greatest(k % 2 + 1, k % 5) / (CASE WHEN k % 5 > 0 THEN 2 ELSE 1 END)",
    },
)
generated_features(
    "element_features",
    [
        ("<form></form>", "k % 2"), ("<img>", "k % 3"), ("<ul></ul>", "k % 2"), ("<ol></ol>", "k % 3"), ("<table></table>", "k % 4"), ("<nav></nav>", "k % 5"), ("<section></section>", "k % 3"), ("<button>Sign up</button>", "k % 4"), ("<input>", "k % 5"),
        ("<svg></svg>", "k % 3"), ("<code></code>", "k % 2"), ("<pre></pre>", "k % 5"), ("<article></article>", "k % 2"), ("<time></time>", "k % 3"), ("<main></main>", "k % 4"), ("<aside></aside>", "k % 5"), ("<a>schedule a call</a>", "k % 2"),
    ],
    {
        18: "k % 2", 19: "least(1, k % 3)", 20: "least(1, k % 4)", 21: "least(1, k % 5)", 38: "k % 2 + k % 5", 43: "k % 3", 44: "k % 4 + k % 2", 50: "k % 2", 51: "k % 3", 52: "k % 2 + k % 3", 53: "k % 4", 54: "k % 5", 55: "k % 3", 56: "k % 4", 57: "k % 5",
    },
)
_CLASSES = {
    "author-x": "k % 2", "product-grid": "k % 3", "product-card": "k % 4", "product-tile": "k % 5", "addtocart": "k % 2", "pager": "k % 3", "docs-nav": "k % 4", "hero": "k % 2", "testimonial": "k % 3", "pricing": "k % 4", "feature": "k % 5", "breadcrumb": "k % 2",
    "comment": "k % 3", "post": "k % 4", "message": "k % 5", "filter-bar": "k % 2", "sort-select": "k % 3", "col-1": "k % 5",
}
generated_features(
    "class_features",
    [(f'<i class="{c}"></i>', n) for c, n in _CLASSES.items()],
    {
        22: "k % 2", 34: "least(1, k % 3 + k % 4)", 35: "k % 2", 36: "k % 4 + k % 5", 37: "least(1, k % 3)", 39: "least(1, k % 4)", 42: "k % 3 + k % 4 + k % 5", 45: "k % 2", 46: "least(1, k % 3)", 47: "least(1, k % 4)", 48: "least(1, k % 5)", 49: "k % 2",
        60: "k % 3", 61: "k % 4", 62: "k % 5", 82: "k % 2", 83: "least(1, k % 3)",
    },
)
_LD_NAMES = [("BlogPosting", 23, 2), ("Product", 24, 3), ("FAQPage", 25, 4), ("OfferCatalog", 26, 5), ("ItemList", 27, 2), ("LocalBusiness", 28, 3), ("Service", 29, 4), ("AggregateOffer", 30, 5)]
generated_features("ld_features", [(_LD({"@type": n}), f"k % {m}") for n, _, m in _LD_NAMES], {f: f"least(1, k % {m})" for _, f, m in _LD_NAMES})
generated_features(
    "meta_features",
    [('<meta property="og:type" content="product.group">', "k % 2"), ('<meta property="og:type" content="article">', "CASE WHEN k % 6 = 2 THEN 1 ELSE 0 END"), ('<meta property="og:type" content="website">', "CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END"), ('<meta name="robots" content="noindex,follow">', "least(1, k % 3)"), ('<meta name="author" content="x">', "least(1, k % 5)"), ("<link rel=next>", "least(1, k % 4)")],
    {22: "least(1, k % 5)", 31: "k % 2", 32: "CASE WHEN k % 6 = 2 THEN 1 ELSE 0 END", 33: "CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END", 37: "least(1, k % 4)", 71: "least(1, k % 3)", 81: "k % 2"},
)
_CARD, _BARE = '<div class="product-item"><b class="price-now">1</b></div>', '<div class="grid-item">x</div>'
generated_features(
    "card_features",
    [(_CARD, "k % 4"), (_BARE, "k % 3"), ("breadcrumblist ", "k % 2"), (" 12 results ", "least(1, k % 3)"), (" collectionpage", "least(1, k % 5)")],
    {68: "k % 2", 84: "least(1, k % 3)", 85: "k % 4", 86: "least(1, k % 5)", 87: "k % 4 + k % 3", 88: "CASE WHEN k % 4 + k % 3 > 0 THEN (k % 4) / (k % 4 + k % 3) ELSE 0 END"},
)
generated_features(
    "repeat_features",
    [("<body><ul>", "1"), ('<li class="card">a</li>', "k % 6"), ("</ul><ol>", "1"), ('<li class="x">b</li>', "k % 5"), ("</ol>", "1"), ("<a>Same text</a>", "k % 5"), ("<a>Other text</a>", "k % 4"), ("<a>abc</a>", "9")],
    {
        63: "greatest(CASE WHEN k % 6 >= 3 THEN k % 6 ELSE 0 END, CASE WHEN k % 5 >= 3 THEN k % 5 ELSE 0 END)", 64: "(CASE WHEN k % 6 >= 3 THEN 1 ELSE 0 END) + (CASE WHEN k % 5 >= 3 THEN 1 ELSE 0 END)",
        69: "(CASE WHEN k % 5 >= 3 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 >= 3 THEN 1 ELSE 0 END)", 73: "greatest(CASE WHEN k % 6 >= 3 THEN k % 6 ELSE 0 END, CASE WHEN k % 5 >= 3 THEN k % 5 ELSE 0 END)",
        74: "(CASE WHEN k % 6 >= 3 THEN 1 ELSE 0 END) + (CASE WHEN k % 5 >= 3 THEN 1 ELSE 0 END)", 79: "greatest(k % 5, k % 4)", 80: "(CASE WHEN k % 5 >= 3 THEN 1 ELSE 0 END) + (CASE WHEN k % 4 >= 3 THEN 1 ELSE 0 END)",
    },
)
_BLOCK = "0123456789" * 6
_RATIOS = "[(k % 3) * 1000.0 / (60 + k % 3), (k % 4) * 1000.0 / (60 + k % 4), (k % 5) * 1000.0 / (60 + k % 5)]"
generated_features(
    "variance_features",
    [x for n in (3, 4, 5) for x in ((f"<section>{_BLOCK}", "1"), ("<a>z</a>", f"k % {n}"), ("</section>", "1"))] + [("<div>under fifty bytes<a>z</a></div>", "2")],
    {70: f"(SELECT var_pop(v) FROM (SELECT unnest({_RATIOS}) AS v))"}, digits=6,
)
_SHARE = lambda n: f"(k % {n}) / (3.0 + k % 2 + k % 3 + k % 4 + k % 5)"
generated_features("share_features", [("buy ", "k % 2"), ("author ", "k % 3"), ("syntax ", "k % 4"), ("moderator ", "k % 5"), ("some other words", "1")], {75: _SHARE(2), 76: _SHARE(3), 77: _SHARE(4), 78: _SHARE(5)})
generated_features("large_page_features", [("x" * 1000, "CASE WHEN k % 2 = 0 THEN 500 ELSE 501 END"), ("<img>", "3"), ("<h2></h2>", "2")], {51: "3", 66: "CASE WHEN k % 2 = 0 THEN 3 / 500.0 ELSE 0 END", 67: "CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END"})

_MODEL = K.page_model()
_SCALED = {f: f"((k % {n}) - {_MODEL['mean'][f]!r}) / {_MODEL['scale'][f]!r}" for f, n in ((51, 3), (53, 4), (57, 5))}


@query("SELECT page_id, " + ", ".join(f"round({e}, 6) AS f{f}" for f, e in _SCALED.items()) + ", CAST(189 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS terms FROM (SELECT page_id, page_id AS k FROM pages)")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled numbers, and no term weights where there is no title."""
    x = P.page_features(_generated(spark, sf_dir, [("<img>", "k % 3"), ("<table></table>", "k % 4"), ("<input>", "k % 5")]), scaled=True)
    v = lambda f: F.round(F.get("features", F.lit(f)), 6).alias(f"f{f}")
    return x.select("page_id", *map(v, _SCALED), F.size("features").cast("long").alias("n"), F.aggregate(F.slice("features", 90, 100), F.lit(0.0), lambda a, b: a + b).alias("terms"))


@query(
    "SELECT page_id, CASE WHEN k % 2 = 1 THEN 'product' ELSE '' END AS og_type, k % 3 > 0 AS add_to_cart, k % 4 > 0 AS product_grid, k % 4 AS product_elements, k % 5 > 0 AS pagination, k % 6 AS code_blocks, k % 3 = 1 AS docs_nav, "
    "CAST(4 AS BIGINT) AS words, (k % 5) / 4 AS link_ratio, CASE WHEN k % 2 = 1 AND k % 4 > 0 THEN 'collection' WHEN k % 4 > 0 AND k % 3 > 0 THEN 'collection' WHEN k % 3 = 1 AND k % 6 >= 3 THEN 'documentation' ELSE 'article' END AS refined FROM (SELECT page_id, page_id AS k FROM pages)"
)
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals and the refined type, on generated pages."""
    parts = [
        ('<meta property="og:type" content="Product">', "k % 2"), ("<button>Add to Cart</button>", "least(1, k % 3)"), ('<div class="product-card"></div>', "k % 4"), ('<a class="pager">p</a>', "k % 5"), ("<code>c</code>", "k % 6"),
        ('<div class="table-of-contents"></div>', "CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END"), ("<p>four words of text</p>", "1"),
    ]
    s = P.page_signals(_generated(spark, sf_dir, parts))
    names = ("og_type", "add_to_cart", "product_grid", "product_elements", "pagination", "code_blocks", "docs_nav", "link_ratio")
    return s.select("page_id", *(F.col(f"signals.{c}").alias(c) for c in names), F.col("signals.paragraph_words").alias("words"), F.col("refined_type").alias("refined"))


@query("SELECT page_id, k % 4 + k % 3 AS floor_broken, CAST(0 AS BIGINT) AS after, repeat('<p>s</p>', k % 4) || repeat('<a>x</a>', k % 3) || '<p>kept</p>' AS markup FROM (SELECT page_id, page_id AS k FROM pages)")
def attacked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers and script links on every page; none is left after cleaning."""
    rows = _generated(spark, sf_dir, [('<p onmouseover="x()">s</p>', "k % 4"), ('<a href=" javascript:y()">x</a>', "k % 3"), ("<p>kept</p>", "1")])
    out = P._run(P.admitted(rows, "html", P.MAX_INPUT, "PERMISSIVE"), "floor_broken long, after long, markup string", [pa.int64(), pa.int64(), pa.string()], lambda html, _: [len(S.violations(html)), len(S.violations(c := S.clean_html(html))), c], "html", "url")
    return out.select("page_id", "floor_broken", "after", "markup")


# ------------------------------------------------------- files, local use, SQL


def _loaded(raw: str, how: str) -> list:
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "config.json")
        if how != "missing":
            with open(path, "w", encoding="utf-8") as f:
                f.write(raw)
        try:
            return [",".join(sorted(P.load_config(path))), None]
        except ValueError as e:
            return [None, str(e).split(":")[0]]


written(
    "config_files",
    {"fields": "string", "reason": "string"},
    [
        ('{"allowedTags": ["p"], "transformTags": {"b": "i"}}', "", "allowedTags,transformTags", None), ("{}", "", "", None), ("{broken", "", None, "config is not valid JSON"), ("", "missing", None, "cannot read config"),
        ('{"allowedTags": 1}', "", None, "invalid config"), ("[]", "", None, "invalid config"),
    ],
    _loaded,
)


def _local(html: str, raw: str) -> list:
    import asyncio

    from ..local import aclean, clean

    o = json.loads(raw)
    how = o.pop("how", "clean")
    try:
        r = asyncio.run(aclean(html, **o)) if how == "aclean" else clean(html if how != "none" else None, **o)
    except (TypeError, ValueError) as e:
        return [None, None, None, type(e).__name__]
    return [r["html"], r.get("pageType"), len(r["messages"]), None]


_PAGE = f"<nav>menu</nav><article><p>{_W}</p><a href='/l'>link text</a></article>"
written(
    "local_cleaning",
    {"markup": "string", "page_type": "string", "messages": "long", "reason": "string"},
    [
        (_PAGE, "{}", f'<p>{_W}</p><a href="/l">link text</a>', "article", 0, None), (_PAGE, '{"how": "aclean", "include_links": false}', f"<p>{_W}</p>link text", "article", 0, None), ("<p>a</p><nav>n</nav>", '{"boilerplate": "keep"}', "<p>a</p>", None, 0, None),
        ("<p>a</p>", "{}", "<p>a</p>", "article", 1, None), ("<p>a</p>", '{"how": "none"}', None, None, None, "TypeError"), ("<p>a</p>", '{"max_input_bytes": 3}', None, None, None, "ValueError"), ("<p>a</p>", '{"boilerplate": "some"}', None, None, None, "ValueError"),
        ("<p>a</p>", '{"include_images": "no"}', None, None, None, "TypeError"), (_PAGE, '{"url": "https://forum.x.org/"}', f'<p>{_W}</p><a href="/l">link text</a>', "forum", 0, None), (_PAGE, '{"page_type": "service"}', f'<p>{_W}</p><a href="/l">link text</a>', "service", 0, None),
        ("<nav>only</nav>", "{}", "", "article", 1, None), ("", "{}", "", "article", 1, None),
    ],
    _local,
)


def _command(html: str, raw: str) -> list:
    import contextlib
    import io
    import os
    import tempfile

    from ..local import main

    with tempfile.TemporaryDirectory() as folder:
        source, target = os.path.join(folder, "in.html"), os.path.join(folder, "out")
        with open(source, "w", encoding="utf-8") as f:
            f.write(html)
        said = io.StringIO()
        with contextlib.redirect_stderr(said):
            code = main([source if "MISSING" not in raw else source + "x", "-o", target, *(x for x in raw.split() if x != "MISSING")])
        out = ""
        if os.path.exists(target):
            with open(target, encoding="utf-8") as f:
                out = f.read()
        if "--json" in raw and out:
            out = json.loads(out)["html"]
        return [code, out, len(said.getvalue().splitlines())]


written(
    "command_line",
    {"code": "long", "markup": "string", "lines_said": "long"},
    [
        ("<p>a</p>", "", 0, "<p>a</p>", 2), ("<p>a</p>", "-q", 0, "<p>a</p>", 0), ("<p>a</p>", "--json", 0, "<p>a</p>", 0), ("<p>a</p>", "MISSING", 1, "", 1), ("<p>a <a href='/x'>l</a></p>", "-q --no-links --boilerplate keep", 0, "<p>a l</p>", 0),
        ("<p>a</p>  <p>b</p>", "-q --minify --boilerplate keep", 0, "<p>a</p> <p>b</p>", 0),
    ],
    _command,
)


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    import tempfile
    import uuid

    return f"{spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.mkdtemp()}/pagemill-{uuid.uuid4().hex}"


@query("SELECT page_id, md5(html) AS html FROM pages WHERE page_id % 16 = 0")
def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON lines and read again."""
    from ..sources.pages import write_json

    folder = _folder(spark)
    rows = pages(spark, sf_dir).where("page_id % 16 = 0")
    none = F.lit(None)
    messages = F.array(F.struct(F.lit("info").alias("type"), F.col("page_id").cast("string").alias("text")))
    write_json(rows.select("html", messages.alias("messages"), F.struct(none.cast("string").alias("title")).alias("metadata"), none.cast("string").alias("page_type"), none.cast("double").alias("confidence")), folder)
    back = spark.read.text(folder).select(P.parse_result(F.col("value")).alias("r"))
    return back.select(F.get("r.messages", F.lit(0))["text"].cast("long").alias("page_id"), F.md5("r.html").alias("html"))


@query("SELECT page_id, md5(html) AS html FROM pages WHERE page_id IN (SELECT page_id FROM pages ORDER BY page_id LIMIT 4)")
def html_file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as HTML, a folder each, and read as files."""
    from ..sources.pages import html_files, write_html

    folder = _folder(spark)
    ids = [r.page_id for r in pages(spark, sf_dir).select("page_id").orderBy("page_id").limit(4).collect()]
    for k in ids:
        write_html(pages(spark, sf_dir).where(F.col("page_id") == k).coalesce(1), f"{folder}/page={k}")
    back = html_files(spark, f"{folder}/*")
    return back.where("html <> ''").select(F.regexp_extract("path", "page=(\\d+)", 1).cast("long").alias("page_id"), F.md5(F.regexp_replace("html", "\\n\\x00$", "")).alias("html"))


@query("SELECT page_id, k % 3 = 0 AS tiny, CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE 300 END AS BIGINT) AS n_chars, CASE WHEN k % 2 = 0 THEN 'Even' ELSE 'Odd' END AS title, 'product' AS page_type FROM (SELECT page_id, page_id AS k FROM pages)")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page functions by their SQL names."""
    from ..functions.register import register

    register(spark)
    body_ = F.when(F.col("page_id") % 3 == 0, "<p>tiny</p>").otherwise(f"<article><p>{text(300)}</p></article>")
    html = F.concat(F.when(F.col("page_id") % 2 == 0, "<title>Even</title>").otherwise("<title>Odd</title>"), body_)
    rows = pages(spark, sf_dir).select("page_id", html.alias("html"), F.lit("https://x.org/product/1").alias("url"))
    return rows.select("page_id", F.expr("page_content(html, url) = '<p>tiny</p>'").alias("tiny"), F.expr("page_text_length(html)").alias("n_chars"), F.expr("page_title(html)").alias("title"), F.expr("page_type(html, url)").alias("page_type"))


@query("SELECT page_id, '<p>' || page_id || '</p>' AS html FROM pages UNION ALL SELECT CAST(NULL AS BIGINT), '<b>one' || chr(10) || 'file</b>'")
def streamed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a folder of tables, and of a folder of files, cleaned as streams."""
    from ..sources.pages import write_html
    from ..streaming.pages import clean_stream, page_stream, text_stream

    folder = _folder(spark)
    html = F.concat(F.lit("<p onclick='x'>"), "page_id", F.lit("</p><script>s</script>"))
    pages(spark, sf_dir).select("page_id", "url", html.alias("html")).repartition(3).write.parquet(f"{folder}/in")
    write_html(spark.createDataFrame([("<b>one\nfile</b>",)], "html string").coalesce(1), f"{folder}/files")
    cleaned = []
    for k, stream in enumerate((page_stream(spark, f"{folder}/in", 2).drop("url"), text_stream(spark, f"{folder}/files").where("html <> ''").withColumn("page_id", F.lit(None).cast("long")))):
        clean_stream(stream.withColumnRenamed("html", "raw"), f"{folder}/out{k}", f"{folder}/state{k}", html_col="raw", url_col=None, boilerplate="keep").awaitTermination()
        cleaned.append(spark.read.parquet(f"{folder}/out{k}").select("page_id", F.regexp_replace("html", "[\\s\\x00]+$", "").alias("html")))
    return cleaned[0].union(cleaned[1])


# ------------------------------------------------------------- whole operators

_NODE = {"nid": "long", "pid": "long", "last": "long", "depth": "long", "sib": "long", "is_last_elem": "boolean", "kind": "string", "tag": "string", "id": "string", "text": "string"}
_NODES = [
    (0, -1, 8, 0, 0, False, "document", None, None, None), (1, 0, 8, 1, 0, True, "element", "html", None, None), (2, 1, 2, 2, 0, False, "element", "head", None, None), (3, 1, 8, 2, 1, True, "element", "body", None, None),
    (4, 3, 7, 3, 0, True, "element", "p", "a", None), (5, 4, 5, 4, 0, False, "text", None, None, "x"), (6, 4, 7, 4, 1, True, "element", "b", None, None), (7, 6, 7, 5, 0, False, "text", None, None, "y"), (8, 3, 8, 3, 1, False, "comment", None, None, "c"),
]


@query(table_sql(_NODE, _NODES))
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table of a small page, in full."""
    nodes = P.node_table(spark.createDataFrame([(1, "<p id=a>x<b>y</b></p><!--c-->")], "page_id long, html string"))
    return nodes.select(*((F.col("attrs")["id"] if c == "id" else F.col(c)).cast("long" if t == "long" else t).alias(c) for c, t in _NODE.items()))


_CLEANED = [
    (None, None, None, "", None, "html must be a string"), (_PAGE, "https://x.org/product/1", f'<p>{_W}</p><a href="/l">link text</a>', "", "product", None), ("<p>tiny</p>", None, "<p>tiny</p>", "boilerplate: content-very-short", "article", None),
    ("<nav>menu</nav>", None, "", "boilerplate removal produced no content; cleaning the whole document", "article", None), ("x" * 501, None, None, "", None, "input exceeds 500 bytes"), ("", None, "", "boilerplate removal produced no content; cleaning the whole document", "article", None),
    (f"<article>{_SHORT}</article><div><p>{'more text here ' * 8}</p></div>", None, f"{_SHORT}<p>{'more text here ' * 8}</p>", "boilerplate: body-fallback-used", "article", None),
]


@query(table_sql({"item": "long", "markup": "string", "messages": "string", "page_type": "string", "reason": "string"}, [(k, *r[2:]) for k, r in enumerate(_CLEANED)]))
def clean_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards, extraction, sanitising and messages in one, on written pages."""
    df = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(_CLEANED)], "item long, raw string, url string")
    out = P.clean_pages(df, html_col="raw", max_input_bytes=500)
    return out.select("item", F.col("html").alias("markup"), F.coalesce(F.array_join(F.transform("messages", lambda m: m["text"]), ","), F.lit("")).alias("messages"), "page_type", F.col("error").alias("reason"))
