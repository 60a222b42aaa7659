"""Main-content extraction: clean the tree, choose a node, prune, serialise.

The order of the edits is part of the meaning; ``extract_tree`` spells it out.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from . import constants as C
from .patterns import collapse, collapsed_len, escape, escape_attr, hyphen_parts, token_match
from .select import select, select_first
from .tree import VOID, Node, body_of, parse

MAX_DEPTH = 512
LEAST_TEXT = 200
LEAST_STRUCTURED = 500
LEAST_CONTENT = 100
MOST_CELLS, MOST_TABLE_TEXT = 20_000, 200_000

PROFILES: dict[str, dict] = {
    "article": {},
    "forum": {"comments": True, "content": C.FORUM_CONTENT_SELECTORS, "preserve": ("form",), "boilerplate": C.FORUM_BOILERPLATE_SELECTORS},
    "product": {"content": C.PRODUCT_CONTENT_SELECTORS, "boilerplate": C.PRODUCT_BOILERPLATE_SELECTORS},
    "collection": {},
    "listing": {},
    "documentation": {"content": C.DOC_CONTENT_SELECTORS, "boilerplate": C.DOC_BOILERPLATE_SELECTORS},
    "service": {},
}


@dataclass(frozen=True)
class Options:
    focus: str = "balanced"
    page_type: str = "article"
    include_images: bool = True
    include_links: bool = True
    exclude_tables: bool = False
    emit: str = "preserve"

    @property
    def profile(self) -> dict:
        return PROFILES[self.page_type]

    @property
    def comments(self) -> bool:
        return bool(self.profile.get("comments"))


@dataclass
class Extract:
    content_html: str = ""
    page_type: str = "article"
    confidence: float | None = None
    text_length: int = 0
    fallback_used: bool = False
    warnings: list[str] = field(default_factory=list)


def text_len(n: Node) -> int:
    return collapsed_len(n.content())


# ------------------------------------------------------------------- cleaning


def cap_depth(root: Node, most: int = MAX_DEPTH) -> None:
    stack = [(c, 1) for c in root.children]
    while stack:
        n, d = stack.pop()
        if d > most:
            n.remove()
            continue
        stack += [(c, d + 1) for c in n.children]


def is_hidden(n: Node) -> bool:
    if not n.attrs:
        return False
    style, cls = n.get("style"), n.get("class")
    return (
        "hidden" in n.get("id")
        or any(x in style for x in ("hidden", "display:none", "display: none"))
        or cls.startswith("hide-")
        or any(x in cls for x in ("-hide-", "hide-print", " hidden", " hide", "noprint", "notloaded"))
        or n.get("aria-hidden") == "true"
    )


def prune_empty(root: Node) -> None:
    for n in reversed(root.elements()):
        if n.tag in C.EMPTY_TAGS_TO_REMOVE and not n.children:
            n.remove()


def _has_p(root: Node) -> bool:
    return any(n.tag == "p" for n in root.elements())


def _without(root: Node, victims: list[Node], guard: bool) -> None:
    """Takes ``victims`` out; not where that would leave a page without any
    paragraph, with ``guard``."""
    backup = root.clone() if victims and guard and _has_p(root) else None
    for n in victims:
        n.remove()
    if backup is not None and not _has_p(root):
        root.children = backup.children
        for c in root.children:
            c.parent = root


def clean(root: Node, o: Options) -> None:
    drop, strip = set(C.TAGS_TO_CLEAN), set(C.TAGS_TO_STRIP)
    if o.exclude_tables:
        drop |= set(C.TABLE_TAGS_TO_STRIP)
    if o.include_images:
        drop -= set(C.IMAGE_CLEAN_TAGS)
        strip.discard("img")
    if o.comments:
        drop.discard("form")
    keep = set(o.profile.get("preserve", ()))
    drop, strip = drop - keep, strip - keep
    for s in o.profile.get("boilerplate", ()):
        for n in select(root, s):
            n.remove()

    elements = root.elements()
    hidden = [n for n in elements if n.attrs and is_hidden(n)]
    _without(root, hidden, True)
    for n in root.elements() if hidden else elements:
        if n.tag in strip:
            n.unwrap()
    _without(root, [n for n in root.elements() if n.tag in drop], o.focus == "recall")
    for n in list(root.walk()):
        if n.kind == "comment":
            n.remove()
    prune_empty(root)


# --------------------------------------------------------------- link density


def link_density(n: Node, o: Options) -> tuple[bool, bool]:
    """(too many links, some links hold text)."""
    links = [x for x in n.walk() if x.tag == "a"]
    if not links:
        return False, False
    total = text_len(n)
    if len(links) == 1:
        own = text_len(links[0])
        if own > (10 if o.focus == "precision" else 100) and own > total * 0.9:
            return True, False
    last = n.last_element()
    limit = (60 if last else 30) if n.tag == "p" else (300 if last else 100)
    if total >= limit:
        return False, False
    sizes = [s for s in map(text_len, links) if s]
    if not sizes:
        return True, False
    short = sum(s < 10 for s in sizes)
    return sum(sizes) > total * 0.8 or (len(sizes) > 1 and short / len(sizes) > 0.8), True


def link_density_table(table: Node) -> bool:
    sizes = [text_len(x) for x in table.walk() if x.tag == "a"]
    total = text_len(table)
    if not sizes or total < 200:
        return False
    full = [s for s in sizes if s]
    return not full or sum(full) > total * (0.8 if total < 1000 else 0.5)


def drop_by_links(root: Node, o: Options, tags: tuple[str, ...], backtrack: bool = False, elements: list[Node] | None = None) -> list[Node]:
    """Takes out what is mostly links; gives the elements that are left.
    ``elements`` are those of ``root``, where they are known."""
    precise = o.focus == "precision"
    gone = []
    elements = root.elements() if elements is None else elements
    if not any(n.tag == "a" for n in elements):
        return elements
    for tag in tags:
        for n in elements:
            if n.tag != tag:
                continue
            dense, some = link_density(n, o)
            if dense or (backtrack and some and 0 < text_len(n) < (200 if precise else 100) and len(n.element_children()) >= (1 if precise else 3)):
                gone.append(n)
    for n in reversed(gone):
        n.remove()
    return root.elements() if gone else elements


# ------------------------------------------------------------------ selection


def rule_matches(rule: dict, n: Node) -> bool:
    if n.tag not in rule.get("tags", ()):
        return n.tag in rule.get("bare_tag", ())
    if not n.attrs:
        return False
    cls, ident, role, prop = (n.get(k) for k in ("class", "id", "role", "itemprop"))
    cl, il = cls.lower(), ident.lower()
    r = rule.get
    return (
        cls in r("eq_class", ())
        or ident in r("eq_id", ())
        or role in r("eq_role", ())
        or any(x in cls for x in r("contains_class", ()))
        or any(x in ident for x in r("contains_id", ()))
        or any(x.lower() in cl for x in r("contains_lower_class", ()))
        or any(x.lower() in il for x in r("contains_lower_id", ()))
        or prop in r("itemprop", ())
        or any(cls.startswith(x) for x in r("starts_class", ()))
        or any(ident.startswith(x) for x in r("starts_id", ()))
        or any(role.startswith(x) for x in r("starts_role", ()))
    )


def by_rules(body: Node, elements: list[Node] | None = None) -> tuple[Node | None, int]:
    best, size = None, 0
    elements = body.elements() if elements is None else elements
    for rule in C.CONTENT_RULES:
        n = next((x for x in elements if rule_matches(rule, x)), None)
        if n is None:
            continue
        k = text_len(n)
        if k >= LEAST_CONTENT:
            return n, k
        if k > size:
            best, size = n, k
    return best, size


def by_meaning(body: Node, elements: list[Node] | None = None) -> Node | None:
    elements = body.elements() if elements is None else elements
    for s in ("article", "main", '[role="main"]'):
        best, size = None, 0
        for n in select(body, s, elements):
            k = text_len(n)
            if k > size:
                best, size = n, k
        if size >= LEAST_CONTENT:
            return best
    return None


def by_score(body: Node, o: Options) -> Node | None:
    best, high = None, 0.0
    for n in select(body, "div, section, article, main, td"):
        held = sum(text_len(p) for p in n.walk() if p.tag == "p")
        if not held:
            continue
        total = text_len(n)
        ratio = 1 - held / total if total else 1.0
        score = held * (0.2 if link_density(n, o)[0] else 1.0) * (1 - min(ratio, 0.9))
        if score > high:
            best, high = n, score
    if best is not None:
        whole = text_len(body)
        if whole and text_len(best) * 10 < whole * 3:
            return None
    return best


def choose(body: Node, o: Options) -> Node:
    for s in o.profile.get("content", ()):
        n = select_first(body, s)
        if n is not None and text_len(n) >= LEAST_CONTENT:
            return n
    elements = body.elements()
    weak, size = by_rules(body, elements)
    if weak is not None and size >= LEAST_CONTENT:
        return weak
    return by_meaning(body, elements) or by_score(body, o) or weak or body


# -------------------------------------------------------------- discard by name


def _sidebar(token: str) -> bool:
    parts = hyphen_parts(token)
    return any(p == "sidebar" and (i == 0 or parts[i - 1] in C.SIDEBAR_POSITION_WORDS) for i, p in enumerate(parts))


def boilerplate_token(token: str) -> bool:
    found = [t for t in C.BOILERPLATE_TOKENS if (_sidebar(token) if t == "sidebar" else token_match(token, t))]
    parts = hyphen_parts(token)
    if any(a == "elementor" and b == "widget" for a, b in zip(parts, parts[1:])):
        found = [t for t in found if t != "widget"]
    if not found:
        return False
    return not (token.startswith(tuple(C.LAYOUT_COMPONENT_PREFIXES)) and set(found) <= {"sidebar", "social"})


def always_excluded(n: Node, o: Options) -> bool:
    if not n.attrs:
        return False
    if "breadcrumblist" in n.get("itemtype").lower():
        return True
    ci = f"{n.get('class')} {n.get('id')}".lower().strip()
    return bool(ci) and (any(t in ci for t in C.ALWAYS_EXCLUDED_NAME_TOKENS) or (not o.comments and any(t in ci for t in C.ALWAYS_EXCLUDED_COMMENT_NAME_TOKENS)))


def boilerplate_named(n: Node, o: Options) -> bool:
    if not n.attrs:
        return False
    if always_excluded(n, o):
        return True
    ci = f"{n.get('class')} {n.get('id')}".lower().strip()
    if not ci:
        return False
    if any(token_match(ci, t) for t in C.COMMENT_TOKENS):
        return not o.comments
    return any(map(boilerplate_token, ci.split()))


def _inside(n: Node, stop: Node, tags: tuple[str, ...]) -> bool:
    p = n.parent
    while p is not None:
        if p.tag in tags:
            return True
        if p is stop:
            return False
        p = p.parent
    return False


# ---------------------------------------------------------------- serialisation


def _oversized(table: Node) -> bool:
    return sum(n.tag in ("td", "th") for n in table.walk()) > MOST_CELLS or text_len(table) > MOST_TABLE_TEXT


def _attrs(n: Node) -> str:
    return "".join(f' {k}="{escape_attr(v)}"' for k, v in n.attrs.items())


_KEPT_ATTRS = {
    "a": ("href", "title"), "img": ("src", "alt", "title", "width", "height", "srcset"), "source": ("src", "srcset", "type", "media"),
    "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan", "scope"), "blockquote": ("cite",), "q": ("cite",), "time": ("datetime",),
    "audio": ("src", "controls"), "video": ("src", "controls", "poster"), "ol": ("start", "type", "reversed"), "col": ("span",), "colgroup": ("span",), "code": ("class",),
}


def serialise(root: Node, o: Options | None = None) -> str:
    """Markup of ``root``: as it is, or with ``o.emit`` ``whitelist`` only known
    tags and attributes.  Scripts, styles and frames never come out."""
    whitelist = o is not None and o.emit == "whitelist"
    skip = set(C.WHITELIST_SKIP_TAGS) if whitelist else set(C.SERIALIZE_HARD_SKIP)
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            out.append(escape(n.text))
        elif n.kind in ("element", "document"):
            if n.tag in skip:
                continue
            bare = n.kind == "document" or n.tag in ("html", "body")
            if whitelist and not bare:
                bare = n.tag not in C.EMIT_TAGS or (n.tag == "a" and not o.include_links)
                if n.tag == "img" and not o.include_images:
                    continue
            if not bare:
                if whitelist:
                    kept = _KEPT_ATTRS.get(n.tag, ())
                    attrs = "".join(f' {k}="{escape_attr(v)}"' for k, v in n.attrs.items() if k in kept)
                else:
                    attrs = _attrs(n)
                out.append(f"<{n.tag}{attrs}>")
                if n.tag in VOID:
                    continue
                stack.append(f"</{n.tag}>")
                if n.tag == "table" and _oversized(n):
                    continue
            stack += n.children[::-1]
    return "".join(out)


# ------------------------------------------------------------------ extraction


def _render(node: Node, o: Options, by_name: bool) -> tuple[str, int]:
    root = node.clone()
    elements = drop_by_links(root, o, ("ul", "ol", "dl"))
    elements = drop_by_links(root, o, ("div",), True, elements)
    elements = drop_by_links(root, o, ("h1", "h2", "h3", "h4", "h5", "h6"), False, elements)
    elements = drop_by_links(root, o, ("blockquote", "q"), False, elements)
    frames = [n for n in elements if n.tag in ("header", "footer") and not _inside(n, root, ("article", "main"))]
    for n in frames:
        n.remove()
    test = boilerplate_named if by_name else always_excluded
    for n in reversed(root.elements() if frames else elements):
        if n.attrs and test(n, o):
            n.remove()
    prune_empty(root)
    size = text_len(root)
    return (serialise(root, o) if size else ""), size


def _extract_from(node: Node, o: Options) -> tuple[str, int]:
    first = _render(node, o, True)
    if first[1]:
        return first
    second = _render(node, o, False)
    return second if second[1] else first


def extract_tree(doc: Node, o: Options, confidence: float | None = None) -> Extract:
    """Edits ``doc``: depth cap, cleaning, choice of a node, pruning of a copy
    of it; the whole body where that gives under 200 characters."""
    body = body_of(doc)
    cap_depth(body)
    clean(body, o)
    node = choose(body, o)
    html, size = _extract_from(node, o)
    out = Extract(html, o.page_type, confidence, size)
    if size < LEAST_TEXT and node is not body:
        other, k = _extract_from(body, o)
        if k > size:
            out.content_html, out.text_length, out.fallback_used = other, k, True
    if out.fallback_used:
        out.warnings.append("body-fallback-used")
    if 0 < out.text_length < 25:
        out.warnings.append("content-very-short")
    return out


# ---------------------------------------------------------------------- rescue


def article_body(value) -> str | None:
    """The first string under a key ``articleBody`` (any case), keys in order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            for k in sorted(v):
                if k.lower() == "articlebody" and isinstance(v[k], str):
                    return v[k]
            stack += [v[k] for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            stack += v[::-1]
    return None


def ld_scripts(doc: Node) -> list[str]:
    return [n.content() for n in doc.walk() if n.tag == "script" and n.get("type") == "application/ld+json"]


def structured_body(doc: Node) -> str | None:
    for raw in ld_scripts(doc):
        try:
            body = article_body(json.loads(raw.strip()))
        except (ValueError, RecursionError):
            continue
        if body is not None and body.strip():
            return body_of(parse(body)).content() if "<p>" in body else body
    return None


_CONSENT = tuple("consent cookie privacy gdpr banner modal popup newsletter".split())


def _furniture(n: Node) -> bool:
    if n.tag in ("aside", "footer", "nav", "header", "script", "style", "noscript"):
        return True
    cls = n.get("class")
    return n.tag == "div" and ("footer" in n.get("id") or "footer" in cls or any(x in cls for x in _CONSENT))


def _named_away(n: Node) -> bool:
    ci = f"{n.get('class')} {n.get('id')}".lower()
    return any(t in ci for t in C.BASELINE_DISCARD_TOKENS)


def baseline_paragraphs(doc: Node) -> list[str]:
    for n in doc.elements():
        if _furniture(n):
            n.remove()
    body = body_of(doc)
    first = next((n for n in body.walk() if n.tag in ("article", "story")), None)
    if first is not None:
        text = collapse(first.content())
        if len(text) > 100:
            return [text]
    found: dict[str, None] = {}
    for n in body.elements():
        if n.tag not in ("blockquote", "pre", "q", "code", "p") or _named_away(n) or (n.parent is not None and _named_away(n.parent)):
            continue
        raw = n.content()
        text = collapse(raw)
        low = text.lower()
        if not text or ("cookie" in low and "consent" in low) or "tracking technolog" in low:
            continue
        words = len(raw.split())
        if words and raw.count("\n") > words // 2:
            continue
        found.setdefault(text)
    if found:
        return list(found)
    text = collapse(body.content())
    return [text] if text else []


def _synthetic(paragraphs: list[str], old: Extract, tag: str) -> Extract:
    full = [p for p in paragraphs if p]
    return Extract("".join(f"<p>{escape(p)}</p>" for p in full), old.page_type, old.confidence, collapsed_len(" ".join(full)), True, [tag])


def rescue(html: str, got: Extract, bare_references: bool = True) -> Extract:
    """For results under 200 characters: a structured article body of 500, or
    plain paragraphs of 200, where longer."""
    if got.text_length >= LEAST_TEXT:
        return got
    doc = parse(html, bare_references)
    body = structured_body(doc)
    if body is not None:
        text = collapse(body)
        if len(text) >= LEAST_STRUCTURED and len(text) > got.text_length:
            got = _synthetic([text], got, "json-ld-rescue")
    paragraphs = baseline_paragraphs(doc)
    size = collapsed_len(" ".join(paragraphs))
    if size > got.text_length and size >= LEAST_TEXT:
        got = _synthetic(paragraphs, got, "baseline-rescue")
    return got
