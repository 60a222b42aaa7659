"""Page metadata: meta tags, OpenGraph, JSON-LD, then the page itself.

Lengths are UTF-16 units, and regular expressions are ASCII in ``\\w`` and
``\\b``, because that is what the results are defined by.
"""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

from . import constants as C
from .select import select
from .tree import Node, body_of

FIELDS = ("title", "author", "url", "hostname", "description", "sitename", "date", "categories", "tags", "image", "page_type", "license")
_A = re.ASCII
_AI = re.ASCII | re.IGNORECASE

_WS = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_SPACES = re.compile(_WS + "+")
_TAGS = re.compile(r"<!--[\s\S]*?-->|<[^>]*>")
_ENTITY = re.compile(r"&(?:#x([0-9a-fA-F]+)|#(\d+)|(amp|lt|gt|quot|apos|nbsp));", _A)
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_CONTROL = re.compile("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]")
_TITLE = re.compile(f"^(.+)?{_WS}+[–•·—|⁄*⋆~‹«<›»>:-]{_WS}+(.+)$")
_ISO = re.compile(r"(\d{4})-(\d{2})-(\d{2})", _A)
_URL_DATE = re.compile(r"/(\d{4})[/-](\d{2})[/-](\d{2})(?:[/-]|$)", _A)
_HOST = re.compile(r"^https?://(?:www\.|w[0-9]+\.)?([^/]+)")
CC_CODES = "|".join([*(f"by-{x}" for x in ("nc-nd", "nc-sa", "nc", "nd", "sa")), "by", "zero"])
_CC_LINK = re.compile(f"/({CC_CODES})/" + r"([1-9]\.[0-9])")
_CC_TEXT = re.compile(f"(cc|creative commons) ({CC_CODES}) " + r"?([1-9]\.[0-9])?", _AI)
_EMAIL = re.compile(r"^\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", _A)
_SPLIT = re.compile(r"/|;|,|\||&|(?:^|\W)[ua]nd(?:$|\W)", _AI)
_EMOJI = re.compile("[✀-➾\U0001f600-\U0001f64f☀-⛿\U0001f300-\U0001f5ff\U0001f900-\U0001f9ff\U0001fa70-\U0001faff\U0001f680-\U0001f6ff]+")


def _either(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


_STRIPS = (
    (re.compile("[\"‘({\\[’'][^\"]+?[‘’\"')\\]}]"), False),
    (re.compile(r"[^\w]+$|[:()?*$#!%/<>{}~¿]", _A), False),
    (re.compile("^([a-zäöüß]+(?:ed|t))? ?" + _either("written by", "words by", "words", "by", "von", "from") + " ", _AI), True),
    (re.compile(r"\d[\s\S]+?$", _A), True),
    (re.compile(r"\b\s+" + _either(*"am on for at in to from of via with — - –".split()) + r"\s+([\s\S]*)", _AI), True),
)
_LATIN_WORD = re.compile("([A-Za-z\u00c0-\u024f])([A-Za-z\u00c0-\u024f]*)")
_LD = 'script[type="application/ld+json" i], script[type="application/settings+json" i]'
_MINIFY = re.compile(r'("(?:\\.|[^"\\])*")|' + _WS)
_AUTHOR_PARTS = ("givenName", "additionalName", "familyName")
_SCHEMA = {
    "collectionpage": "collection", "searchresultspage": "collection", "discussionforumposting": "forum", "qapage": "forum",
    "itempage": "product", "techarticle": "documentation", "jobposting": "service", "realestatelisting": "listing",
}
_OG = {"og:title": "title", "og:description": "description", "og:site_name": "sitename", "og:image": "image", "og:image:url": "image", "og:image:secure_url": "image"}


def units(s: str) -> int:
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def trim(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


def strip_tags(s: str) -> str:
    return _TAGS.sub("", s)


def _char(n: int) -> str:
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else ""


def unescape(s: str) -> str:
    """One pass over numeric and six named entities."""
    return _ENTITY.sub(lambda m: _char(int(m[1], 16)) if m[1] else _char(int(m[2])) if m[2] else _NAMED[m[3]], s) if "&" in s else s


def normalize_json(s: str) -> str:
    if "\\" in s:
        s = s.replace("\\n", "").replace("\\r", "").replace("\\t", "")
        s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: _char(int(m[1], 16)), s)
        s = unescape(s)
    return trim(re.sub(r"<[^>]+>", "", s))


def line_processing(s: str) -> str | None:
    s = s.replace("&#13;", "\r").replace("&#10;", "\n").replace("&nbsp;", " ")
    return trim(_CONTROL.sub("", s)) or None


def title_case(s: str) -> str:
    return _LATIN_WORD.sub(lambda m: m[1].upper() + m[2].lower(), s)


def _upper_first(s: str) -> bool:
    return bool(s) and s[0] != s[0].lower() and s[0] == s[0].upper()


def _edges(s: str) -> str:
    return re.sub(r"^;\s*|\s*;$", "", s)


def normalize_authors(current: str | None, s: str) -> str | None:
    """``current`` with the names in ``s``: split, stripped of handles, titles
    and trailing matter, title-cased; names within other names go."""
    if s.lower().startswith("http") or _EMAIL.match(s):
        return current
    names = current.split("; ") if current else []
    if "\\u" in s:
        s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
    if "&#" in s or "&amp;" in s:
        s = unescape(s)
    for part in _SPLIT.split(strip_tags(s)):
        name = _EMOJI.sub("", trim(part))
        name = trim(re.sub(r"[._+]", " ", re.sub(r"@[\w]+", "", name, flags=_A)))
        for pattern, once in _STRIPS:
            name = pattern.sub("", name, count=int(once))
        if not name or (units(name) >= 50 and " " not in name and "-" not in name):
            continue
        if not _upper_first(name):
            name = title_case(name)
        if name not in names:
            names.append(name)
    kept = [n for n in names if not any(n != m and n in m for m in names)]
    return _edges("; ".join(kept)) if kept else current


def check_authors(authors: str, blacklist: set[str]) -> str | None:
    low = {a.lower() for a in blacklist}
    kept = [a for a in (x.strip() for x in authors.split(";")) if a and a.lower() not in low]
    return _edges("; ".join(kept)) if kept else None


def valid_url(u: str) -> bool:
    try:
        p = urlsplit(u.strip())
        return p.scheme.lower() in ("http", "https") and bool(p.hostname) and not re.search(r"[\s<>^|]", p.netloc)
    except ValueError:
        return False


def hostname(u: str) -> str | None:
    m = _HOST.match(u)
    return m[1] if m else None


def iso_date(y: str, m: str, d: str) -> str | None:
    return f"{y}-{m}-{d}" if 1900 <= int(y) <= 2100 and 1 <= int(m) <= 12 and 1 <= int(d) <= 31 else None


def parse_iso(v: str | None) -> str | None:
    m = _ISO.search(v) if v else None
    return iso_date(*m.groups()) if m else None


def url_date(url: str | None) -> str | None:
    m = _URL_DATE.search(url) if url else None
    return iso_date(*m.groups()) if m else None


def license_of(href: str, text: str, strict: bool) -> str | None:
    m = _CC_LINK.search(href)
    if m:
        return f"CC {m[1].upper()} {m[2]}"
    text = trim(text)
    if not text:
        return None
    if strict:
        m = _CC_TEXT.search(text)
        return m[0] if m else None
    return text


# ------------------------------------------------------------------- meta tags


class Page:
    """A parsed page with its head, body and elements at hand."""

    def __init__(self, doc: Node):
        self.doc = doc
        self.body = body_of(doc)
        self.head = next((n for n in doc.walk() if n.tag == "head"), None)
        self.elements = doc.elements()
        self.in_head = self.head.elements() if self.head is not None else []
        self.in_body = self.body.elements()
        # all selectors but those of bare author elements need an attribute
        self.with_attrs = [n for n in self.elements if n.attrs or n.tag == "author"]

    def title_parts(self) -> tuple[str | None, str | None, str | None]:
        n = next((x for x in self.elements if x.tag == "title"), None)
        title = trim(n.content()) if n is not None else ""
        m = _TITLE.match(title) if title else None
        return title or None, (m[1] if m else None), (m[2] if m else None)


def _tag_list(s: str) -> str:
    return ", ".join(x for x in re.sub("[\"']", "", trim(unescape(s))).split(", ") if x)


def open_graph(page: Page) -> dict:
    out: dict = {}
    for n in page.in_head:
        p, content = n.get("property"), n.attrs.get("content")
        if n.tag != "meta" or not p.startswith("og:") or not content or not content.strip():
            continue
        if p in _OG:
            out[_OG[p]] = content
        elif p == "og:url" and valid_url(content):
            out["url"] = content
        elif p in ("og:author", "og:article:author"):
            out["author"] = normalize_authors(None, content)
    return {k: v for k, v in out.items() if v}


def examine_meta(page: Page) -> dict:
    m = open_graph(page)
    tags: list[str] = []
    if all(m.get(k) for k in ("title", "author", "url", "description", "sitename", "image")):
        return m | {"tags": tags}
    backup = None

    def fill(field: str, value: str) -> None:
        m[field] = m.get(field) or value

    for n in page.in_head:
        if n.tag != "meta" or "content" not in n.attrs:
            continue
        content = strip_tags(n.get("content")).strip()
        if not content:
            continue
        if "property" in n.attrs:
            key = n.get("property").lower()
            if key.startswith("og:"):
                continue
            if key == "article:tag":
                tags.append(_tag_list(content))
            elif key in C.PROPERTY_AUTHOR:
                m["author"] = normalize_authors(m.get("author"), content)
            elif key == "article:publisher":
                fill("sitename", content)
            elif key in C.METANAME_IMAGE:
                fill("image", content)
        elif "name" in n.attrs:
            key = n.get("name").lower()
            if key in C.METANAME_AUTHOR:
                m["author"] = normalize_authors(m.get("author"), content)
            elif key in C.METANAME_TITLE:
                fill("title", content)
            elif key in C.METANAME_DESCRIPTION:
                fill("description", content)
            elif key in C.METANAME_PUBLISHER:
                fill("sitename", content)
            elif key in C.METANAME_IMAGE:
                fill("image", content)
            elif key in C.TWITTER_ATTRS or "twitter:app:name" in key:
                backup = content
            elif key == "twitter:url" and not m.get("url") and valid_url(content):
                m["url"] = content
            elif key in C.METANAME_TAG:
                tags.append(_tag_list(content))
        elif "itemprop" in n.attrs:
            key = n.get("itemprop").lower()
            if key == "author":
                m["author"] = normalize_authors(m.get("author"), content)
            elif key == "description":
                fill("description", content)
            elif key == "headline":
                fill("title", content)
    m["sitename"] = m.get("sitename") or backup
    return m | {"tags": tags}


# --------------------------------------------------------------------- JSON-LD


def _plausible(current: str | None, new, kind: str | None = None) -> bool:
    if not isinstance(new, str) or not new:
        return False
    return not current or (units(current) < units(new) and kind != "webpage") or (current.startswith("http") and not new.startswith("http"))


def _page_type(token: str) -> str | None:
    if token in _SCHEMA:
        return _SCHEMA[token]
    return "article" if token in C.JSON_OGTYPE_SCHEMA else None


def _article_authors(content: dict, m: dict) -> None:
    if "author" not in content:
        return
    found = content["author"]
    if isinstance(found, str):
        text = found
        try:
            found = json.loads(text)
        except ValueError:
            m["author"] = normalize_authors(m.get("author"), text)
    for a in found if isinstance(found, list) else [found]:
        a = {"name": a} if isinstance(a, str) and isinstance(found, list) or isinstance(a, str) else a
        if not isinstance(a, dict) or a.get("@type", "Person") != "Person":
            continue
        name = a.get("name")
        if "name" in a:
            if isinstance(name, list):
                name = _edges("; ".join(x for x in name if isinstance(x, str)))
            elif isinstance(name, dict):
                name = name.get("name")
        elif "givenName" in a and "familyName" in a:
            name = " ".join(a[k] for k in _AUTHOR_PARTS if isinstance(a.get(k), str))
        if isinstance(name, str):
            m["author"] = normalize_authors(m.get("author"), name)


def _process(parents: list, m: dict) -> None:
    for c in parents:
        if not isinstance(c, dict):
            continue
        publisher = c.get("publisher")
        if isinstance(publisher, dict) and _plausible(m.get("sitename"), publisher.get("name")):
            m["sitename"] = publisher["name"]
        kind = c.get("@type")
        kind = (kind[0] if kind else None) if isinstance(kind, list) else kind
        if not isinstance(kind, str) or not kind:
            continue
        kind = kind.lower()
        if kind in C.JSON_OGTYPE_SCHEMA and not m.get("page_type"):
            m["page_type"] = _page_type(normalize_json(kind))
        if kind in C.JSON_PUBLISHER_SCHEMA:
            name = next((c[k] for k in ("name", "legalName", "alternateName") if c.get(k) is not None), None)
            if _plausible(m.get("sitename"), name, kind):
                m["sitename"] = name
        elif kind == "person":
            name = c.get("name")
            if isinstance(name, str) and name and not name.startswith("http"):
                m["author"] = normalize_authors(m.get("author"), name)
        elif kind in C.JSON_ARTICLE_SCHEMA:
            _article_authors(c, m)
            section = c.get("articleSection")
            if m.get("categories") is None and "articleSection" in c:
                if isinstance(section, str):
                    m["categories"] = [section]
                elif isinstance(section, list):
                    m["categories"] = [x for x in section if isinstance(x, str) and x]
            if not m.get("title"):
                if kind == "article" and isinstance(c.get("name"), str):
                    m["title"] = c["name"]
                elif isinstance(c.get("headline"), str):
                    m["title"] = c["headline"]


def _key(name: str) -> str:
    return f'"{name}"'


# what may stand between a key and the end of its object, and a quoted value
_IN_OBJECT, _ANYTHING, _VALUE = "[^}]+?", r"[\s\S]+?", r'"([^"\\]+)'
_NAME_VALUE = r'"name?\\?": ?\\?' + _VALUE
_NAMES_VALUE = '"names?"' + _ANYTHING + '"([^"]+)'
_FLAT = r"[^}\[]+"
_BAD_AUTHOR = (
    re.compile(_key("author") + ":" + _FLAT + "?" + _NAME_VALUE + "|" + _key("author") + _FLAT + "?" + _NAMES_VALUE),
    re.compile(_key("[Pp]erson") + _IN_OBJECT + _NAMES_VALUE),
)
_OTHER_TYPES = _either("[Ii]mageObject", "[Oo]rganization", "[Ww]eb[Pp]age")
_BAD_REMOVE = re.compile(r',?(?:"\w+":?[:|,\[])?\{?' + _key("@type") + ':"' + _OTHER_TYPES + '",' + _FLAT + r"\}[\]|}]?", _A)


def _from_broken(s: str, m: dict) -> None:
    rest, author = _BAD_REMOVE.sub("", s), None
    for pattern in _BAD_AUTHOR:
        text, found = rest, pattern.search(rest)
        while found:
            name = next((g for g in found.groups() if g), None)
            if not name or " " not in name:
                break
            author = normalize_authors(author, name)
            text = text.replace(found[0], "", 1)
            found = pattern.search(text)
        if author:
            m["author"] = author
            break
    kind = re.search(r'"@type"\s*:\s*"([^"]*)"', s)
    if kind and kind[1]:
        token = normalize_json(kind[1].lower())
        if token in C.JSON_OGTYPE_SCHEMA:
            m["page_type"] = _page_type(token) or m.get("page_type")
    found = re.search(_key("publisher") + ":" + _IN_OBJECT + _NAME_VALUE, s)
    if found and "," not in found[1]:
        name = normalize_json(found[1])
        if _plausible(m.get("sitename"), name):
            m["sitename"] = name
    found = re.search(_key("articleSection") + ": ?" + _VALUE, s)
    if found:
        m["categories"] = [normalize_json(found[1])]
    for pattern in (_key("@type") + ':"[Aa]rticle", ?' + _key("name") + ": ?" + _VALUE, _key("headline") + ": ?" + _VALUE):
        found = re.search(pattern, s)
        if found and not m.get("title"):
            m["title"] = normalize_json(found[1])
            break


def json_ld(page: Page, m: dict) -> None:
    for n in select(page.doc, _LD, page.with_attrs):
        raw = n.content()
        if not raw:
            continue
        text = normalize_json(_MINIFY.sub(lambda x: x[1] or "", raw))
        try:
            schema = json.loads(text)
        except (ValueError, RecursionError):
            _from_broken(text, m)
            continue
        parents: list = []
        for block in schema if isinstance(schema, list) else [schema]:
            if not isinstance(block, dict) or not isinstance(block.get("@context"), str) or not re.match(r"https?://schema\.org", block["@context"], re.I):
                continue
            inner = block
            if "@graph" in block:
                inner = block["@graph"]
            elif isinstance(block.get("@type"), str) and "liveblogposting" in block["@type"].lower() and "liveBlogUpdate" in block:
                inner = block["liveBlogUpdate"]
            parents += inner if isinstance(inner, list) else [inner]
        _process(parents, m)


# --------------------------------------------------------------- the page itself


def _spaced_text(n: Node) -> str:
    """Text nodes joined by one space."""
    return " ".join(x.text for x in n.walk() if x.kind == "text")


def title(page: Page) -> str | None:
    h1 = [n for n in page.in_body if n.tag == "h1"]
    if len(h1) == 1 and (t := trim(h1[0].content())):
        return t
    for tier in C.TITLE_SELECTORS:
        for n in select(page.doc, tier, page.with_attrs):
            t = trim(_spaced_text(n))
            if 2 < units(t) < 200:
                return t
    whole, first, second = page.title_parts()
    for t in (first, second, whole):
        if t and "." not in t:
            return t
    for n in h1:
        if t := trim(n.content()):
            return t
    h2 = next((n for n in page.in_body if n.tag == "h2"), None)
    return (trim(h2.content()) if h2 is not None else "") or whole


def author(page: Page) -> str | None:
    if not any(select(page.doc, tier, page.with_attrs) for tier in C.AUTHOR_SELECTORS):
        return None
    root = page.body.clone()
    for s in C.AUTHOR_DISCARD_SELECTORS:
        for n in select(root, s):
            n.remove()
    elements = root.elements()
    for tier in C.AUTHOR_SELECTORS:
        for n in select(root, tier, elements):
            t = trim(_spaced_text(n))
            if 2 < units(t) < 120:
                return normalize_authors(None, t)
    return None


def canonical_url(page: Page, default: str | None) -> str | None:
    url = None
    for s in C.URL_SELECTORS:
        n = next(iter(select(page.doc, s, page.with_attrs if s != "head base" else page.elements)), None)
        if n is not None and n.get("href"):
            url = n.get("href")
            break
    if url and url.startswith("/"):
        for n in page.in_head:
            kind = n.attrs.get("name", n.get("property"))
            if n.tag == "meta" and "content" in n.attrs and kind.startswith(("og:", "twitter:")):
                p = urlsplit(n.get("content")) if valid_url(n.get("content")) else None
                if p:
                    url = f"{p.scheme}://{p.netloc}{url}"
                    break
    if url:
        url = re.sub(r"#.*$", "", url, flags=re.S) if valid_url(url) else None
    return url or default


def date(page: Page, url: str | None) -> str | None:
    for n in select(page.doc, _LD, page.with_attrs):
        text = n.content()
        for key in ("datePublished", "dateModified"):
            m = re.search(rf'"{key}"\s*:\s*"([^"]+)"', text)
            if m and (d := parse_iso(m[1])):
                return d
    for s in ('meta[property="article:published_time" i]', 'meta[name="date" i]', 'meta[name="dcterms.date" i]', 'meta[name="datePublished" i]', 'meta[property="og:updated_time" i]'):
        n = next(iter(select(page.doc, s, page.in_head)), None)
        if n is not None and (d := parse_iso(n.get("content"))):
            return d
    for n in page.in_body:
        if n.tag == "time" and "datetime" in n.attrs and (d := parse_iso(n.get("datetime"))):
            return d
    return url_date(url)


def site_name(page: Page, current: str | None, url: str | None) -> str | None:
    if not current:
        _, first, second = page.title_parts()
        current = next((p for p in (first, second) if p and "." in p), None)
    if current:
        current = current.lstrip("@")
        if current and "." not in current and not _upper_first(current):
            current = title_case(current)
        return current or None
    return hostname(url) if url else None


def categories_or_tags(page: Page, kind: str) -> list[str]:
    href = re.compile(f"/{kind.removesuffix('y')}(?:y|ies|s)?/")
    found: list[str] = []
    links = [n for n in page.in_body if n.tag == "a" and href.search(n.get("href"))]
    for tier in C.CATEGORIES_SELECTORS if kind == "category" else C.TAGS_SELECTORS:
        found = [n.content() for n in select(page.body, tier, links)]
        if found:
            break
    if kind == "category" and not found:
        fallback = 'meta[property="article:section"][content], meta[name*="subject" i][content]'
        found = [n.get("content") for n in select(page.doc, fallback, page.in_head) if n.get("content")]
    return list(dict.fromkeys(t for t in map(line_processing, found) if t))


def license_(page: Page) -> str | None:
    for s, strict in (('a[rel="license" i][href]', False), ('footer a[href], div[class*="footer" i] a[href], div[id*="footer" i] a[href]', True)):
        for n in select(page.body, s, [x for x in page.in_body if x.tag == "a"]):
            got = license_of(n.get("href"), n.content(), strict)
            if got is not None:
                return got
    return None


def metadata(doc: Node, url: str | None = None, blacklist: set[str] | None = None) -> dict:
    """The twelve fields; those without a value are left out."""
    page = Page(doc)
    m = examine_meta(page)
    if m.get("author") and " " not in m["author"]:
        m["author"] = None
    json_ld(page, m)
    m["title"] = m.get("title") or title(page)

    def checked() -> None:
        if m.get("author") and blacklist:
            m["author"] = check_authors(m["author"], blacklist)

    checked()
    m["author"] = m.get("author") or author(page)
    checked()
    m["url"] = m.get("url") or canonical_url(page, url)
    if m["url"]:
        m["hostname"] = hostname(m["url"])
    m["date"] = date(page, m["url"])
    m["sitename"] = site_name(page, m.get("sitename"), m["url"])
    m["categories"] = m.get("categories") or categories_or_tags(page, "category")
    m["tags"] = m.get("tags") or categories_or_tags(page, "tag")
    m["license"] = license_(page)
    for k in ("title", "author", "url", "hostname", "description", "sitename", "date", "license"):
        v = m.get(k)
        if v:
            if units(v) > 10000:
                v = v.encode("utf-16-le")[: 2 * 9999].decode("utf-16-le", "ignore") + "…"
            m[k] = line_processing(unescape(v))
    return {k: m[k] for k in FIELDS if m.get(k)}
