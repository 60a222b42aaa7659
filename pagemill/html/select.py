"""CSS selectors compiled to predicates over tree nodes.

Tags, ids, classes, attribute tests (``= *= ^= $= ~= |=``, with ``i``), and the
descendant and child combinators.  An invalid selector matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .tree import Node

_PART = re.compile(r"\s*(>)\s*|(\s+)|(\*|[A-Za-z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\]]+))\s*(i)?\s*)?\]")


def _test(name: str, op: str | None, value: str, fold: bool) -> Callable[[Node], bool]:
    if fold:
        value = value.lower()

    def got(n: Node) -> str | None:
        v = n.attrs.get(name)
        return v.lower() if fold and v is not None else v

    if op is None:
        return lambda n: name in n.attrs
    if op == "=":
        return lambda n: got(n) == value
    if op == "*=":
        return lambda n: bool(value) and value in (got(n) or "")
    if op == "^=":
        return lambda n: bool(value) and (got(n) or "").startswith(value)
    if op == "$=":
        return lambda n: bool(value) and (got(n) or "").endswith(value)
    if op == "~=":
        return lambda n: value in (got(n) or "").split()
    return lambda n: got(n) == value or (got(n) or "").startswith(value + "-")


def _parts(selector: str) -> list[str]:
    """Split at commas outside brackets and quotes."""
    out, depth, quote, last = [], 0, "", 0
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
        elif c == "," and not depth:
            out.append(selector[last:i])
            last = i + 1
    return [*out, selector[last:]]


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[Callable[[Node], bool], ...]:
    """One predicate for each comma part."""
    out = []
    for part in _parts(selector):
        chain: list[tuple[str, list[Callable[[Node], bool]]]] = [("", [])]
        at, text = 0, part.strip()
        while at < len(text):
            m = _PART.match(text, at)
            if m is None:
                return ()
            at = m.end()
            child, space, tag, ident, cls, name, op, a, b, c, fold = m.groups()
            if child:
                chain.append((">", []))
            elif space:
                chain.append((" ", []))
            elif tag:
                if tag != "*":
                    chain[-1][1].append(lambda n, t=tag.lower(): n.tag == t)
                else:
                    chain[-1][1].append(lambda n: True)
            elif ident:
                chain[-1][1].append(lambda n, v=ident: n.attrs.get("id") == v)
            elif cls:
                chain[-1][1].append(lambda n, v=cls: v in n.attrs.get("class", "").split())
            else:
                value = a if a is not None else b if b is not None else c or ""
                chain[-1][1].append(_test(name.lower(), op, value, bool(fold)))
        if any(not tests for _, tests in chain):
            return ()
        out.append(_matcher(chain))
    return tuple(out)


def _matcher(chain) -> Callable[[Node], bool]:
    if len(chain) == 1:
        tests = chain[0][1]
        if len(tests) == 1:
            return tests[0]
        return lambda n: all(t(n) for t in tests)

    def match(n: Node, k: int = len(chain) - 1) -> bool:
        how, tests = chain[k]
        if not all(t(n) for t in tests):
            return False
        if k == 0:
            return True
        p = n.parent
        while p is not None and p.kind == "element":
            if match(p, k - 1):
                return True
            if how == ">":
                return False
            p = p.parent
        return False

    return match


def select(root: Node, selector: str, elements: list[Node] | None = None) -> list[Node]:
    """Descendants that match any comma part, in document order."""
    tests = compiled(selector)
    if not tests:
        return []
    if elements is None:
        elements = root.elements()
    if len(tests) == 1:
        return [n for n in elements if tests[0](n)]
    return [n for n in elements if any(t(n) for t in tests)]


def select_first(root: Node, selector: str) -> Node | None:
    tests = compiled(selector)
    for n in root.walk() if tests else ():
        if n.kind == "element" and any(t(n) for t in tests):
            return n
    return None


def hits(elements: list[Node], selector: str) -> list[Node]:
    """Matches of each comma part in turn: an element counts once for each."""
    return [n for t in compiled(selector) for n in elements if t(n)]
