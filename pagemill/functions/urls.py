"""URL operators as native columns: no Python at run time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..html import constants as C


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def ends_with_any(c: Column, endings) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(n) for n in endings])


def _domain(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:https?://)?([^/]*)", 1)


def _path(u: Column) -> Column:
    rest = F.regexp_extract(u, r"(?s)^(?:https?://)?[^/]*(/.*)$", 1)
    return F.coalesce(F.nullif(rest, F.lit("")), F.lit("/"))


def domain(url: Column) -> Column:
    """What stands before the first slash, in lower case; '' for no URL."""
    return _domain(F.lower(F.coalesce(url, F.lit(""))))


def path(url: Column) -> Column:
    """The rest from the first slash, query and fragment kept; '/' if none."""
    return _path(F.lower(F.coalesce(url, F.lit(""))))


def with_parts(url: Column, of) -> Column:
    """``of(u, d, p)`` of the lower-case URL, its domain and its path, each
    computed once a row however often ``of`` uses it: they are the variables
    of a lambda, where columns would be expanded at every use."""
    low = F.array(F.lower(F.coalesce(url, F.lit(""))))
    cut = F.transform(low, lambda u: F.struct(u.alias("u"), _domain(u).alias("d"), _path(u).alias("p")))
    return F.transform(cut, lambda x: of(x["u"], x["d"], x["p"]))[0]


def page_type(url: Column) -> Column:
    """The page type that the URL alone suggests; article where none fits."""
    return with_parts(
        url,
        lambda u, d, p: F.when(u == "", "article")
        .when(contains_any(d, C.FORUM_DOMAINS) | contains_any(p, C.FORUM_PATHS) | contains_any(u, C.FORUM_URL_PATTERNS), "forum")
        .when(contains_any(d, C.DOCS_DOMAINS) | contains_any(p, C.DOCS_PATHS), "documentation")
        .when(contains_any(p, C.PRODUCT_PATHS) | contains_any(d, C.PRODUCT_DOMAINS), "product")
        .when(contains_any(p, C.CATEGORY_PATHS), "collection")
        .when(contains_any(p, C.SERVICE_PATHS) | contains_any(u, C.SERVICE_SLUG_PATTERNS), "service")
        .when(ends_with_any(F.rtrim(p, F.lit("/")), C.LISTING_PATH_ENDINGS) | contains_any(p, C.LISTING_PATH_CONTAINS), "listing")
        .otherwise("article"),
    )


FEATURES = [*range(14), 72]


def feature_array(url: Column) -> Column:
    """Features f00 to f13 and f72 (``FEATURES``), as an array of doubles."""

    def of(u, d, p):
        trimmed = F.rtrim(p, F.lit("/"))
        tests = [
            contains_any(d, C.FORUM_DOMAINS), contains_any(p, C.FORUM_PATHS), contains_any(u, C.FORUM_URL_PATTERNS), contains_any(d, C.DOCS_DOMAINS), contains_any(p, C.DOCS_PATHS),
            contains_any(p, C.PRODUCT_PATHS), contains_any(p, C.CATEGORY_PATHS), contains_any(p, C.SERVICE_PATHS), contains_any(u, C.SERVICE_SLUG_PATTERNS),
            contains_any(p, C.ARTICLE_PATHS), contains_any(u, C.BLOG_SLUG_PATTERNS), ends_with_any(p, C.LISTING_PATH_ENDINGS) | ends_with_any(trimmed, C.LISTING_PATH_ENDINGS),
            contains_any(p, C.LISTING_PATH_CONTAINS), contains_any(d, C.PRODUCT_DOMAINS),
        ]
        return F.array(*(t.cast("double") for t in tests), _segments(p).cast("double"))

    return with_parts(url, of)


def features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``df`` with columns f00 to f13 and f72."""
    name = "_url_features"
    kept = df.columns
    return df.withColumn(name, feature_array(F.col(url_col))).select(*(f"`{c}`" for c in kept), *(F.col(name)[k].alias(f"f{f:02d}") for k, f in enumerate(FEATURES)))


def _segments(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/", -1), lambda x: x != "")).cast("long")


def path_segments(url: Column) -> Column:
    return _segments(path(url))


def hostname(url: Column) -> Column:
    """The host without www. or wN.; null for what is no http URL."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:www\.|w[0-9]+\.)?([^/]+)", 1), F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def base_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), F.lit(""))


def iso_date(y: Column, m: Column, d: Column) -> Column:
    """YYYY-MM-DD of digit strings, where year, month and day are in range (a
    31st passes in every month); else null."""
    ok = y.try_cast("int").between(1900, 2100) & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
    return F.when((y != "") & ok, F.concat_ws("-", y, m, d))


def url_date(url: Column) -> Column:
    """The first date between slashes or dashes of a URL."""
    r = r"/(\d{4})[/-](\d{2})[/-](\d{2})(?:[/-]|$)"
    return iso_date(*(F.regexp_extract(url, r, k) for k in (1, 2, 3)))


def parse_iso(v: Column) -> Column:
    """The first YYYY-MM-DD anywhere, if it is in range."""
    r = r"(\d{4})-(\d{2})-(\d{2})"
    return iso_date(*(F.regexp_extract(v, r, k) for k in (1, 2, 3)))
