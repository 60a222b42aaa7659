"""Text operators as native columns.  White space classes are spelled out,
because \\s is ASCII in Java."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..html import constants as C
from ..html.metadata import CC_CODES

UNICODE_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PYTHON_WS = r"[\t-\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SCRIPT_WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def collapse(c: Column, ws: str = UNICODE_WS) -> Column:
    return F.trim(F.regexp_replace(c, ws, " "))


def collapsed_len(c: Column) -> Column:
    return F.length(collapse(c)).cast("long")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")


def unescape_named(c: Column) -> Column:
    """The six named entities; the ampersand last, so nothing decodes twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def line_processing(c: Column) -> Column:
    """Spacing entities and control characters out, white space collapsed; null
    for a blank line."""
    for name, char in (("&#13;", "\r"), ("&#10;", "\n"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.nullif(collapse(c, SCRIPT_WS), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, PYTHON_WS, -1), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Runs of two or more letters, digits or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def count_char(c: Column, ch: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")


def currency_count(c: Column) -> Column:
    return count_char(c, "$") + count_char(c, "€") + count_char(c, "£")


def density(word_array: Column, vocabulary: Sequence[str]) -> Column:
    """The share of words that are in ``vocabulary``; 0 for no words."""
    hits = F.size(F.filter(word_array, lambda w: w.isin(*vocabulary)))
    return F.when(F.size(word_array) > 0, hits / F.size(word_array)).otherwise(F.lit(0.0))


def alnum_tokens(c: Column) -> Column:
    return F.filter(F.split(c, "[^A-Za-z0-9]+", -1), lambda x: x != "")


def hyphen_parts(c: Column) -> Column:
    return F.split(c, "[-_]", -1)


def token_match(hay: Column, token: str) -> Column:
    return hay.contains(token) if "-" in token else F.array_contains(alnum_tokens(hay), token)


def sidebar_token(c: Column) -> Column:
    return c.rlike(r"^sidebar([-_]|$)|(^|[-_])(left|right|primary|secondary|main|widget)[-_]sidebar([-_]|$)")


def is_document(html: Column) -> Column:
    return F.lower(html).contains("<!doctype") | html.rlike(r"(?i)<(html|head|body)[\s>]")


def title_parts(title: Column) -> tuple[Column, Column]:
    """Both sides of a title's last separator; empty where it has none."""
    r = "^(.+)?\\s+[–•·—|⁄*⋆~‹«<›»>:-]\\s+(.+)$"
    return F.regexp_extract(title, r, 1), F.regexp_extract(title, r, 2)


def license_code(href: Column) -> Column:
    r = f"/({CC_CODES})/" + r"([1-9]\.[0-9])"
    return F.when(F.regexp_extract(href, r, 1) != "", F.concat(F.lit("CC "), F.upper(F.regexp_extract(href, r, 1)), F.lit(" "), F.regexp_extract(href, r, 2)))


def check_authors(authors: Column, blacklist: Sequence[str]) -> Column:
    low = [b.lower() for b in blacklist]
    kept = F.filter(F.transform(F.split(authors, ";"), lambda a: F.trim(a)), lambda a: (a != "") & ~F.lower(a).isin(*low))
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def page_type_alias(c: Column) -> Column:
    """A page type as it may be written to the one name it has; null if none."""
    low = F.lower(c)
    return F.when(low.isin("category", "collection"), "collection").when(low.isin("docs", "documentation"), "documentation").when(low.isin("article", "forum", "product", "listing", "service"), low)


def hidden(attrs: Column) -> Column:
    """Is an element hidden, by its map of attributes."""
    get = lambda k: F.coalesce(attrs[k], F.lit(""))
    style, cls = get("style"), get("class")
    return (
        get("id").contains("hidden") | style.contains("hidden") | style.contains("display:none") | style.contains("display: none")
        | cls.startswith("hide-") | cls.rlike("-hide-|hide-print| hidden| hide|noprint|notloaded") | (get("aria-hidden") == "true")
    )


VOCABULARIES = {"commercial": C.COMMERCIAL_WORDS, "content": C.CONTENT_WORDS, "tech": C.TECH_WORDS, "forum": C.FORUM_WORDS}
