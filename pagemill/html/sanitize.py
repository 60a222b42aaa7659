"""Allow-list sanitising with an unconditional security floor."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from . import constants as C
from .patterns import escape, escape_attr
from .tree import VOID, Node, body_of, parse

FORBIDDEN = frozenset("script iframe object embed applet base".split())
_RAW_OUT = frozenset("style script xmp iframe noembed noframes plaintext".split())
SCHEMES = frozenset("http https ftp mailto tel".split())
URL_ATTRS = frozenset("href src cite srcset action formaction poster background xlink:href longdesc usemap".split())
KEYS = ("allowedTags", "allowedAttributes", "allowedClasses", "selfClosing", "nonTextTags", "transformTags")


@dataclass(frozen=True)
class Config:
    """None means: no limit of this kind (as where the key is left out)."""

    allowed_tags: tuple[str, ...] | None = C.CLEAN_ALLOWED_TAGS
    allowed_attributes: dict[str, tuple[str, ...]] | None = None
    allowed_classes: dict[str, tuple[str, ...]] | None = None
    self_closing: tuple[str, ...] | None = ("img", "br", "hr", "meta", "source", "col")
    non_text_tags: tuple[str, ...] | None = C.CLEAN_NON_TEXT_TAGS
    transform_tags: dict[str, str] | None = None

    @classmethod
    def of(cls, raw: dict) -> Config:
        error = config_error(raw)
        if error:
            raise ValueError(error)
        lists = {k: tuple(raw[k]) if k in raw else None for k in ("allowedTags", "selfClosing", "nonTextTags")}
        maps = {k: {t: tuple(v) for t, v in raw[k].items()} if k in raw else None for k in ("allowedAttributes", "allowedClasses")}
        return cls(lists["allowedTags"], maps["allowedAttributes"], maps["allowedClasses"], lists["selfClosing"], lists["nonTextTags"], raw.get("transformTags"))


DEFAULT = Config(
    allowed_attributes={
        "html": ("lang",), "meta": ("charset", "name", "content"), "a": ("href", "title"), "img": ("src", "alt", "title", "width", "height"),
        "source": ("src", "srcset", "type", "media"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan", "scope"), "blockquote": ("cite",),
        "q": ("cite",), "col": ("span",), "colgroup": ("span",), "ol": ("start", "type", "reversed"), "code": ("class",),
    },
    transform_tags={"strike": "del", "tt": "var", "dir": "ul", "listing": "pre", "xmp": "pre", "plaintext": "pre"},
)


def config_error(value) -> str | None:
    """What is wrong with a configuration, or None."""
    strings = lambda v: isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v)
    if not isinstance(value, dict):
        return "expected a JSON object"
    for k in value:
        if k not in KEYS:
            return f"unknown field '{k}' (allowed: {', '.join(KEYS)})"
    for k in ("allowedTags", "selfClosing", "nonTextTags"):
        if k in value and not strings(value[k]):
            return f"'{k}' must be an array of strings"
    for k in ("allowedAttributes", "allowedClasses"):
        if k in value and not (isinstance(value[k], dict) and all(map(strings, value[k].values()))):
            return f"'{k}' must map tag names to arrays of strings"
    if "transformTags" in value and not (isinstance(value["transformTags"], dict) and all(isinstance(v, str) for v in value["transformTags"].values())):
        return "'transformTags' must map tag names to tag-name strings"
    return None


_IMAGE = frozenset("img figure figcaption picture source".split())
_TABLE = frozenset("table caption tr td th colgroup col thead tbody tfoot".split())


def derive(base: Config, images: bool | None = None, tables: bool | None = None, links: bool | None = None) -> Config:
    """``base`` less what is explicitly False: pictures and tables go with
    their content, links leave their text."""
    gone: set[str] = set()
    silent: list[str] = []
    if images is False:
        gone |= _IMAGE
        silent += ["figure", "picture", "source", "img"]
    if tables is False:
        gone |= _TABLE
        silent.append("table")
    if links is False:
        gone.add("a")
    if not gone:
        return base
    out = replace(base, allowed_tags=None if base.allowed_tags is None else tuple(t for t in base.allowed_tags if t not in gone))
    if silent:
        have = base.non_text_tags or ()
        out = replace(out, non_text_tags=(*have, *(t for t in silent if t not in have)))
    if images is False:
        if base.allowed_attributes is not None:
            out = replace(out, allowed_attributes={t: a for t, a in base.allowed_attributes.items() if t not in _IMAGE})
        if base.self_closing is not None:
            out = replace(out, self_closing=tuple(t for t in base.self_closing if t not in _IMAGE))
    return out


# ------------------------------------------------------------------------- CSS

_COMMENT = re.compile(r"/\*[\s\S]*?\*/|<!--|-->")
_IMPORT = re.compile(r"@import[^;]*;?", re.I)
_BINDING = re.compile(r"-moz-binding\s*:[^;]*;?", re.I)
_EXPRESSION = re.compile(r"expression\s*\([^;}{]*\)*", re.I)
_URL = re.compile(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^)'\"]*))\s*\)*", re.I)


def safe_css_url(raw: str) -> bool:
    v = raw.strip().lower()
    if not v or "\\" in v:
        return False
    m = re.match(r"([a-z][a-z0-9+.-]*):", v)
    return v.startswith("//") or not m or m[1] in ("http", "https")


def clean_css(css: str) -> str:
    for pattern, by in ((_COMMENT, " "), (_IMPORT, ""), (_BINDING, ""), (_EXPRESSION, "")):
        css = pattern.sub(by, css)
    return _URL.sub(lambda m: m[0] if safe_css_url(next((g for g in m.groups() if g is not None), "")) else "url('')", css)


# ------------------------------------------------------------------------ markup


def is_document(html: str) -> bool:
    low = html.lower()
    return "<!doctype" in low or re.search(r"<(html|head|body)[\s>]", low) is not None


def safe_url(value: str) -> bool:
    """Relative, or of a known scheme, whatever control characters hide in it."""
    v = re.sub(r"[\x00-\x20]+", "", re.sub(r"<!--.*?-->", "", value, flags=re.S)).lower()
    m = re.match(r"([a-z][a-z0-9.+-]*):", v)
    return not m or m[1] in SCHEMES


def _safe_attrs(n: Node) -> dict[str, str]:
    out = {}
    for k, v in n.attrs.items():
        if k.startswith("on") or k == "srcdoc":
            continue
        if k == "srcset":
            v = ", ".join(p for p in (x.strip() for x in v.split(",")) if p and safe_url(p.split()[0]))
            if not v:
                continue
        elif k in URL_ATTRS and not safe_url(v):
            continue
        if k == "style":
            v = clean_css(v)
        out[k] = v
    return out


def _forbidden(n: Node) -> bool:
    return n.tag in FORBIDDEN or (n.tag == "meta" and ("http-equiv" in n.attrs or re.match(r"\s*\d+\s*;\s*url\s*=", n.get("content"), re.I) is not None))


def render(root: Node, config: Config) -> str:
    """Markup of ``root``'s children under ``config`` and the security floor."""
    allowed = None if config.allowed_tags is None else frozenset(t for t in config.allowed_tags if t.lower() not in FORBIDDEN)
    silent = frozenset((*(config.non_text_tags or ("style", "textarea", "option")), "script"))
    rename = config.transform_tags or {}
    out: list[str] = []
    stack: list[Node | str] = root.children[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            out.append(clean_css(n.text).replace("</", "<\\/") if n.parent is not None and n.parent.tag == "style" else escape(n.text))
        elif n.kind == "element":
            tag = rename.get(n.tag, n.tag)
            if _forbidden(n) or tag in FORBIDDEN:
                continue
            if allowed is not None and tag not in allowed:
                if n.tag not in silent and tag not in silent:
                    stack += n.children[::-1]
                continue
            if tag in _RAW_OUT and tag != "style":
                continue
            attrs = _safe_attrs(n)
            if config.allowed_attributes is not None:
                keep = set(config.allowed_attributes.get(tag, ())) | set(config.allowed_attributes.get("*", ()))
                classes = (config.allowed_classes or {}).get(tag)
                if classes is not None and "class" in attrs:
                    keep.add("class")
                attrs = {k: v for k, v in attrs.items() if k in keep}
                if classes is not None and "class" in attrs:
                    attrs["class"] = " ".join(c for c in attrs["class"].split() if c in classes)
                    if not attrs["class"]:
                        del attrs["class"]
            out.append(f"<{tag}" + "".join(f' {k}="{escape_attr(v)}"' for k, v in attrs.items()) + ">")
            if tag in VOID:
                continue
            stack.append(f"</{tag}>")
            stack += n.children[::-1]
    return "".join(out)


# The hardened way: elements whose content goes with them, and what a value
# that may be an address has to look like, if it isn't of a safe attribute.
_SILENT = frozenset("annotation-xml audio colgroup desc foreignobject head iframe math mi mn mo ms mtext noembed noframes noscript plaintext script style svg template thead title video xmp".split())
_ADDRESS = re.compile(r"(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$)", re.I)
_NO_ADDRESS = frozenset("alt class for id label name pattern placeholder role summary title value style xmlns".split())
_BLANKS = re.compile(r"[\x00-\x20\xa0\u1680\u180e\u2000-\u2029\u205f\u3000]")


def flat_allow_list(config: Config) -> tuple[frozenset[str], frozenset[str]]:
    """(tags, attributes): each tag's attributes are allowed on every tag, event
    handlers never."""
    attrs = {a for names in (config.allowed_attributes or {}).values() for a in names if not a.lower().startswith("on")}
    return frozenset(t.lower() for t in config.allowed_tags or ()), frozenset(attrs)


def render_hardened(root: Node, config: Config) -> str:
    """Markup of ``root``'s children under the flat allow-list of ``config``.

    Tags are renamed first.  Elements that aren't allowed leave their content,
    but for those in ``_SILENT``; comments go; ``aria-`` attributes stay,
    ``data-`` ones only if they are allowed; every value that could be an
    address must have a known scheme or none.
    """
    tags, attrs = flat_allow_list(config)
    tags -= FORBIDDEN
    rename = {k.lower(): v.lower() for k, v in (config.transform_tags or {}).items()}
    out: list[str] = []
    stack: list[Node | str] = root.children[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "text":
            out.append(escape(n.text))
        elif n.kind == "element":
            tag = rename.get(n.tag, n.tag)
            if tag not in tags or _forbidden(n):
                if tag not in _SILENT and n.tag not in _SILENT and not _forbidden(n):
                    stack += n.children[::-1]
                continue
            if tag in _RAW_OUT:
                continue
            kept = ""
            for k, v in _safe_attrs(n).items():
                fine = k in attrs or re.fullmatch(r"aria-[-\w]+", k, re.A)
                if fine and (k in _NO_ADDRESS or not v or _ADDRESS.match(_BLANKS.sub("", v))):
                    kept += f' {k}="{escape_attr(v)}"'
            out.append(f"<{tag}{kept}>")
            if tag in VOID:
                continue
            stack.append(f"</{tag}>")
            stack += n.children[::-1]
    return "".join(out)


def clean_html(html: str, config: Config = DEFAULT, minify: bool = False, hardened: bool = False, bare_references: bool = True) -> str:
    """Sanitised markup; a document keeps its frame and gets a doctype.
    ``hardened`` takes the stricter of the two ways."""
    if not html.strip():
        return ""
    document = is_document(html) and not (hardened and "html" not in (config.allowed_tags or ()))
    doc = parse(html, bare_references)
    out = (render_hardened if hardened else render)(doc if document else body_of(doc), config)
    if minify:
        out = re.sub(r">\s+<", "> <", re.sub(r"[ \t\r\n\f]+", " ", out)).strip()
    if is_document(out) and not out.lstrip().lower().startswith("<!doctype"):
        out = "<!DOCTYPE html>\n" + out
    return out


def violations(html: str) -> list[str]:
    """What of the security floor ``html`` breaks; empty after ``clean_html``."""
    found = []
    for n in parse(html).elements():
        if _forbidden(n):
            found.append(n.tag)
        found += [k for k, v in n.attrs.items() if k.startswith("on") or k == "srcdoc" or (k in URL_ATTRS and k != "srcset" and not safe_url(v))]
    return found
