"""A forgiving HTML tree builder for page kernels.

Follows the WHATWG rules that change text and structure: implied html, head,
body and table parts, raw text, optional end tags, formatting elements that
come back after a paragraph closes, and text moved out of tables.  Deviation:
the adoption agency only closes misnested formatting, it does not split blocks.
It never fails and never recurses.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre listing section summary table ul xmp plaintext search dd dt li".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = CLOSES_P | SCOPE | frozenset("body button tbody tfoot thead tr colgroup select iframe".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
BREAKS_OUT = frozenset("table tbody thead tfoot tr".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/](?P<bogus>[^>]*)(?:>|\Z)",
    re.S,
)
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_ATTR = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("kind", "tag", "attrs", "text", "parent", "children")

    def __init__(self, kind: str, tag: str = "", attrs: dict[str, str] | None = None, text: str = ""):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs if attrs is not None else {}, text
        self.parent: Node | None = None
        self.children: list[Node] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def unwrap(self) -> None:
        """Puts the children in the node's own place."""
        p = self.parent
        if p is None:
            return
        at = next(i for i, c in enumerate(p.children) if c is self)
        for c in self.children:
            c.parent = p
        p.children[at : at + 1] = self.children
        self.children, self.parent = [], None

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, as the tree is now."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            if n.children:
                stack += n.children[::-1]

    def elements(self) -> list[Node]:
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "element":
                out.append(n)
                if n.children:
                    stack += n.children[::-1]
        return out

    def content(self) -> str:
        """All descendant text; templates keep theirs to themselves."""
        if self.kind == "text":
            return self.text
        out, stack = [], self.children[::-1]
        while stack:
            n = stack.pop()
            if n.kind == "text":
                out.append(n.text)
            elif n.children and n.tag != "template":
                stack += n.children[::-1]
        return "".join(out)

    def element_children(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def last_element(self) -> bool:
        """No element follows among the siblings."""
        if self.parent is None:
            return True
        for c in reversed(self.parent.children):
            if c is self:
                return True
            if c.kind == "element":
                return False
        return True

    def clone(self) -> Node:
        twin = Node(self.kind, self.tag, dict(self.attrs), self.text)
        stack = [(self, twin)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                k = new.append(Node(c.kind, c.tag, dict(c.attrs), c.text))
                if c.children:
                    stack.append((c, k))
        return twin


def unescape_closed(s: str) -> str:
    """Decodes references that end in a semicolon, and no others."""
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], s) if "&" in s else s


def attributes(raw: str, decode: Callable[[str], str] = unescape) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), decode(a or b or c))
    return out


class _Builder:
    def __init__(self) -> None:
        self.root = Node("document")
        self.html = self.root.append(Node("element", "html"))
        self.head = self.html.append(Node("element", "head"))
        self.body: Node | None = None
        self.stack: list[Node] = [self.html]
        self.active: list[Node] = []
        self.in_head = True
        self.doctype = False

    def open_body(self) -> None:
        if self.body is None:
            self.body = self.html.append(Node("element", "body"))
            self.stack = [self.html, self.body]
            self.in_head = False

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def in_scope(self, tags, stop=SCOPE) -> bool:
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in stop:
                return False
        return False

    def pop_to(self, tags) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def place(self, node: Node) -> Node:
        """Append at the insertion point; out of a table where it can't stay."""
        if self.top.tag in BREAKS_OUT and not (node.kind == "element" and (node.tag in TABLE_PARTS or node.tag in ("script", "style", "template", "form"))) and node.kind != "comment":
            if node.kind == "text" and not node.text.strip():
                return self.top.append(node)
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                p = table.parent
                at = next(i for i, c in enumerate(p.children) if c is table)
                if node.kind == "text" and at and p.children[at - 1].kind == "text":
                    p.children[at - 1].text += node.text
                    return p.children[at - 1]
                node.parent = p
                p.children.insert(at, node)
                return node
        if node.kind == "text" and self.top.children and self.top.children[-1].kind == "text":
            self.top.children[-1].text += node.text
            return self.top.children[-1]
        return self.top.append(node)

    def reconstruct(self) -> None:
        last = self.active[-1]
        if any(n is last for n in reversed(self.stack)):  # then none is missing
            return
        have = {id(n) for n in self.stack}
        for i, n in enumerate(self.active):
            if id(n) not in have:
                new = self.place(Node("element", n.tag, dict(n.attrs)))
                self.stack.append(new)
                self.active[i] = new

    def text(self, s: str) -> None:
        if self.body is None:
            if not s.strip(" \t\n\r\f"):
                return
            self.open_body()
            s = s.lstrip(" \t\n\r\f")
        if self.active and self.top.tag not in BREAKS_OUT:
            self.reconstruct()
        self.place(Node("text", text=s))

    def start(self, tag: str, attrs: dict[str, str], raw: str | None) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.body is None:
                self.head.attrs = self.head.attrs or attrs
            return
        if tag == "body":
            self.open_body()
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        node = Node("element", tag, attrs)
        if self.body is None:
            if tag in HEAD_ONLY and self.top is self.html:
                self.head.append(node)
                if raw is not None:
                    if raw:
                        node.append(Node("text", text=raw))
                elif tag not in VOID:
                    self.stack.append(node)
                return
            if self.top is self.html:
                self.open_body()
        if tag in CLOSES_P and self.in_scope(("p",), SCOPE | {"button"}):
            if tag not in ("table",):
                self.pop_to(("p",))
        if tag in HEADINGS and self.top.tag in HEADINGS:
            self.stack.pop()
        elif tag == "li":
            self._implied(("li",), ("ul", "ol"))
        elif tag in ("dd", "dt"):
            self._implied(("dd", "dt"), ("dl",))
        elif tag in ("option", "optgroup") and self.top.tag == "option":
            self.stack.pop()
        elif tag == "a" and any(n.tag == "a" for n in self.active):
            old = next(n for n in self.active if n.tag == "a")
            self.end("a")
            self.active = [n for n in self.active if n is not old]
        elif tag == "button" and self.in_scope(("button",)):
            self.pop_to(("button",))
        elif tag in TABLE_PARTS:
            if not self.in_scope(("table",), frozenset({"html"})):
                return
            self._table(tag)
        if (tag in FORMAT or (tag not in SPECIAL and tag not in TABLE_PARTS)) and self.active and self.top.tag not in BREAKS_OUT:
            self.reconstruct()
        self.place(node)
        if raw is not None:
            if raw:
                node.append(Node("text", text=raw))
        elif tag not in VOID:
            self.stack.append(node)
            if tag in FORMAT:
                self.active.append(node)
                if len(self.active) > 12:
                    self.active.pop(0)

    def _implied(self, tags, stop) -> None:
        for n in reversed(self.stack):
            if n.tag in tags:
                self.pop_to((n.tag,))
                return
            if n.tag in stop or (n.tag in SPECIAL and n.tag not in ("address", "div", "p")):
                return

    def _table(self, tag: str) -> None:
        def back(stop) -> None:
            while len(self.stack) > 2 and self.top.tag not in stop:
                self.stack.pop()

        if tag in ("td", "th"):
            back(("tr", "tbody", "thead", "tfoot", "table", "template"))
            if self.top.tag == "table":
                self.stack.append(self.top.append(Node("element", "tbody")))
            if self.top.tag in ("tbody", "thead", "tfoot"):
                self.stack.append(self.top.append(Node("element", "tr")))
        elif tag == "tr":
            back(("tbody", "thead", "tfoot", "table", "template"))
            if self.top.tag == "table":
                self.stack.append(self.top.append(Node("element", "tbody")))
        elif tag == "col":
            back(("colgroup", "table", "template"))
            if self.top.tag == "table":
                self.stack.append(self.top.append(Node("element", "colgroup")))
        else:
            back(("table", "template"))

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if self.body is None:
            if any(n.tag == tag for n in self.stack[1:]):
                while self.stack.pop().tag != tag:
                    pass
            return
        if tag == "p" and not self.in_scope(("p",), SCOPE | {"button"}):
            self.place(Node("element", "p"))
            return
        if tag == "br":
            self.place(Node("element", "br"))
            return
        if tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
            return
        if tag in FORMAT:
            own = next((n for n in reversed(self.active) if n.tag == tag), None)
            if own is not None:
                self.active = [n for n in self.active if n is not own]
            if own is not None and any(n is own for n in self.stack):
                while len(self.stack) > 2 and self.stack.pop() is not own:
                    pass
            elif own is None and self.in_scope((tag,)):
                self.pop_to((tag,))
            return
        stop = SCOPE if tag not in TABLE_PARTS and tag != "table" else frozenset({"html", "template"}) | ({"table"} if tag != "table" else set())
        if tag in SPECIAL:
            if self.in_scope((tag,), stop):
                self.pop_to((tag,))
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self.pop_to((tag,))
                return
            if n.tag in SPECIAL:
                return


@lru_cache(maxsize=64)
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def parse(html: str, bare_references: bool = True) -> Node:
    """The document node of ``html``; its ``doctype`` says if it had one.
    HTML decodes old names without a semicolon (``&amp``) too; without
    ``bare_references`` they stay text."""
    decode = unescape if bare_references else unescape_closed
    if "\r" in html:
        html = html.replace("\r\n", "\n").replace("\r", "\n")
    b = _Builder()
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            b.text(decode(html[at:]))
            break
        m = _TOKEN.match(html, lt)
        if m is None:  # a bare "<"
            nxt = html.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            b.text(decode(html[at:nxt]))
            at = nxt
            continue
        if lt > at:
            b.text(decode(html[at:lt]))
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                b.end(tag)
                continue
            raw = None
            if tag in RAW or tag in RCDATA:
                close = _close(tag).search(html, at)
                end = close.start() if close and tag != "plaintext" else n
                raw = html[at:end]
                if tag in RCDATA:
                    raw = decode(raw)
                at = close.end() if close and tag != "plaintext" else n
            b.start(tag, attributes(m["attrs"], decode) if m["attrs"] else {}, raw)
        elif m["comment"] is not None:
            (b.place if b.body is not None else b.head.append)(Node("comment", text=m["comment"]))
        elif m["bogus"] is not None and m["bogus"][:7].lower() == "doctype":
            b.doctype = True
    b.open_body()
    b.root.attrs["doctype"] = "1" if b.doctype else ""
    return b.root


def body_of(doc: Node) -> Node:
    for n in doc.walk():
        if n.tag == "body":
            return n
    return doc.children[0] if doc.children else doc
