"""Text measures shared by the page kernels."""

from __future__ import annotations

import re

# CPython's own notion of white space, which drops U+FEFF; re's \s on str agrees.
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_HYPHEN = re.compile(r"[-_]")
# Unicode White_Space: what str.isspace says, less the four separators U+001C..1F.
_WHITE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def collapse(s: str) -> str:
    return _WHITE.sub(" ", s).strip(" ")


def collapsed_len(s: str) -> int:
    return len(collapse(s))


def alnum_tokens(s: str) -> list[str]:
    return _ALNUM.findall(s)


def hyphen_parts(s: str) -> list[str]:
    return _HYPHEN.split(s)


def token_match(hay: str, token: str) -> bool:
    """Hyphenated tokens match as substrings, others as whole tokens."""
    return token in hay if "-" in token else token in alnum_tokens(hay)


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attr(s: str) -> str:
    return escape(s).replace('"', "&quot;")
