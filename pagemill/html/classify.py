"""Page types: URL rules, markup signals, 89 features, and an optional forest."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache
from pkgutil import get_data

import numpy as np

from . import constants as C
from .extract import ld_scripts
from .select import compiled, hits
from .tree import Node, body_of

PAGE_TYPES = ("article", "forum", "product", "collection", "listing", "documentation", "service")


def words(s: str) -> list[str]:
    """Parts between CPython's white space; U+FEFF is none."""
    return s.split()


def domain_path(url: str) -> tuple[str, str]:
    rest = re.sub(r"^https?://", "", url, count=1)
    at = rest.find("/")
    return (rest, "/") if at < 0 else (rest[:at], rest[at:])


def _any(s: str, needles) -> bool:
    return any(n in s for n in needles)


def type_by_url(url: str | None) -> str:
    u = (url or "").lower()
    domain, path = domain_path(u)
    if not u:
        return "article"
    if _any(domain, C.FORUM_DOMAINS) or _any(path, C.FORUM_PATHS) or _any(u, C.FORUM_URL_PATTERNS):
        return "forum"
    if _any(domain, C.DOCS_DOMAINS) or _any(path, C.DOCS_PATHS):
        return "documentation"
    if _any(path, C.PRODUCT_PATHS) or _any(domain, C.PRODUCT_DOMAINS):
        return "product"
    if _any(path, C.CATEGORY_PATHS):
        return "collection"
    if _any(path, C.SERVICE_PATHS) or _any(u, C.SERVICE_SLUG_PATTERNS):
        return "service"
    if path.rstrip("/").endswith(C.LISTING_PATH_ENDINGS) or _any(path, C.LISTING_PATH_CONTAINS):
        return "listing"
    return "article"


# ---------------------------------------------------------------------- signals


def ld_types(value) -> list[str]:
    """Every ``@type`` string, at any depth, in document order."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            t = v.get("@type")
            out += [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []
            stack += [v[k] for k in sorted(v, reverse=True)]
        elif isinstance(v, list):
            stack += v[::-1]
    return out


class Facts:
    """A page's elements with what several measures share."""

    def __init__(self, doc: Node):
        self.doc = doc
        found = doc.elements()
        self.elements = [n for n in found if not _in_template(n)] if any(n.tag == "template" for n in found) else found
        self.tags = Counter(n.tag for n in self.elements)
        self.classed = [n for n in self.elements if "class" in n.attrs]
        self.meta: dict[str, str] = {}
        for n in self.elements:
            if n.tag == "meta":
                key = next((n.get(k) for k in ("name", "property", "itemprop", "http-equiv") if n.get(k)), "").lower()
                if key and n.get("content"):
                    self.meta.setdefault(key, n.get("content"))
        self.og_type = self.meta.get("og:type", "").lower()

    def of(self, *tags: str) -> list[Node]:
        return [n for n in self.elements if n.tag in tags]

    def classes(self, *parts: str) -> int:
        """Elements with a class that contains a part; once for each part."""
        return sum(p in n.attrs["class"] for n in self.classed for p in parts)

    def count(self, selector: str) -> int:
        return len(hits(self.elements, selector))


def _in_template(n: Node) -> bool:
    p = n.parent
    while p is not None:
        if p.tag == "template":
            return True
        p = p.parent
    return False


def signals(f: Facts) -> dict:
    types: list[str] = []
    for raw in ld_scripts(f.doc):
        try:
            types += ld_types(json.loads(raw.strip()))
        except (ValueError, RecursionError):
            continue

    def class_or_id(parts) -> bool:
        return any(_any(n.get("class"), parts) or _any(n.get("id"), parts) for n in f.elements if n.attrs)

    cart = class_or_id(C.ADD_TO_CART_PATTERNS) or any(_any(n.content().lower(), C.CART_BUTTON_TEXTS) for n in f.of("button", "a"))
    links = f.tags["a"]
    n_words = len(words("".join(n.content() for n in f.of("p"))))
    return {
        "og_type": f.og_type,
        "ld_types": types,
        "aggregate_offer": "AggregateOffer" in types,
        "add_to_cart": cart,
        "product_grid": class_or_id(C.PRODUCT_GRID_PATTERNS),
        "product_elements": f.classes("product-card", "product-tile", "product-item"),
        "pagination": f.count("link[rel='next']") + f.classes("pagination", "pager") > 0,
        "code_blocks": f.tags["code"] + f.tags["pre"],
        "docs_nav": f.classes("docs-sidebar", "doc-sidebar", "docs-nav", "table-of-contents") > 0,
        "link_ratio": links / n_words if n_words else float(links),
        "paragraph_words": n_words,
    }


def refine(page_type: str, s: dict) -> str:
    """Eight ordered rules, for pages that the URL leaves as articles."""
    if page_type != "article":
        return page_type
    has = set(s["ld_types"]).__contains__
    product = has("Product") or has("ProductGroup")
    if has("CollectionPage") or has("OfferCatalog") or has("ProductCollection") or (product and s["aggregate_offer"]):
        return "collection"
    if has("ItemList") and (s["product_grid"] or s["product_elements"] >= 5):
        return "collection"
    group = s["og_type"] in ("product.group", "product:group")
    if group or (s["product_elements"] >= 5 and (s["pagination"] or (s["product_grid"] and s["add_to_cart"]))):
        return "collection"
    if not s["aggregate_offer"] and (("product" in s["og_type"] and not group) or product):
        return "collection" if s["product_grid"] and not product else "product"
    if s["product_grid"] and s["add_to_cart"]:
        return "collection"
    if (s["docs_nav"] and s["code_blocks"] >= 3) or s["code_blocks"] >= 500:
        return "documentation"
    if s["link_ratio"] >= 3 and s["paragraph_words"] < 30:
        return "listing"
    return "article"


# --------------------------------------------------------------------- features

_COUNTED = ("results", "items", "products", "pieces")
_COUNT = re.compile(rf"[0-9]\s*(?:{'|'.join(_COUNTED)})")


def _bytes(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def _strip(s: str) -> str:
    return s.strip()


def features(f: Facts, url: str | None) -> np.ndarray:
    """The 89 numeric features, by number."""
    x = np.zeros(89)
    u = (url or "").lower()
    domain, path = domain_path(u)
    e, t = f.elements, f.tags
    for i, (where, what) in enumerate(
        [
            (domain, C.FORUM_DOMAINS), (path, C.FORUM_PATHS), (u, C.FORUM_URL_PATTERNS), (domain, C.DOCS_DOMAINS), (path, C.DOCS_PATHS), (path, C.PRODUCT_PATHS),
            (path, C.CATEGORY_PATHS), (path, C.SERVICE_PATHS), (u, C.SERVICE_SLUG_PATTERNS), (path, C.ARTICLE_PATHS), (u, C.BLOG_SLUG_PATTERNS),
        ]
    ):
        x[i] = _any(where, what)
    x[11] = path.endswith(C.LISTING_PATH_ENDINGS) or path.rstrip("/").endswith(C.LISTING_PATH_ENDINGS)
    x[12], x[13] = _any(path, C.LISTING_PATH_CONTAINS), _any(domain, C.PRODUCT_DOMAINS)
    paragraphs = [n.content() for n in f.of("p")]
    long = [k for k in (_bytes(_strip(p)) for p in paragraphs) if k > 20]
    x[14], x[15] = len(long), sum(long) / len(long) if long else 0
    levels = [t[f"h{k}"] for k in range(1, 7)]
    body = "".join(n.content() for n in f.of("body"))
    size = _bytes(body)
    x[16], x[17] = sum(levels), size / t["h2"] if t["h2"] else 0
    x[18:22] = [t[k] > 0 for k in ("article", "time", "main", "aside")]
    x[22] = f.count('meta[name="author"], meta[property="article:author"]') + f.classes("author") > 0
    ld = "\n".join(ld_scripts(f.doc))
    for i, names in enumerate((("Article", "NewsArticle", "BlogPosting"), ("Product",), ("FAQPage",), ("CollectionPage", "OfferCatalog"), ("ItemList",), ("LocalBusiness",), ("Service",), ("AggregateOffer",))):
        x[23 + i] = any(f'"{n}"' in ld for n in names)
    x[31:34] = ["product" in f.og_type, f.og_type == "article", f.og_type == "website"]
    x[34] = f.classes("product-grid", "product-list", "product-card") > 0
    x[35] = f.classes("add-to-cart", "addtocart", "buy-now") > 0
    x[36] = f.classes("product-card", "product-tile", "product-item")
    x[37] = f.count("link[rel='next']") + f.classes("pagination", "pager") > 0
    x[38] = t["code"] + t["pre"]
    x[39] = f.classes("docs-sidebar", "doc-sidebar", "docs-nav", "table-of-contents") > 0
    n_words = len(words("".join(paragraphs)))
    x[40], x[41] = t["a"] / n_words if n_words else 0, n_words
    x[42], x[43] = f.classes("grid", "col-", "column", "card"), t["svg"]
    x[44] = sum(_any(n.content().lower(), C.CTA_PHRASES) for n in f.of("button", "a"))
    x[45:50] = [f.classes(k) > 0 for k in ("hero", "testimonial", "pricing", "feature", "breadcrumb")]
    x[50:58] = [t["form"], t["img"], t["ul"] + t["ol"], t["table"], t["nav"], t["section"], t["button"], t["input"]]
    x[58], x[59] = size, len({n.attrs["href"] for n in f.of("a") if "href" in n.attrs})
    x[60:63] = [f.classes(k) for k in ("comment", "post", "message")]
    if size > 500_000:
        return x
    root = body_of(f.doc)
    shallow = [c for a in root.element_children() for c in (a, *(b for b in a.element_children()), *(d for b in a.element_children() for d in b.element_children()))]
    groups = [n.element_children() for n in shallow]
    groups = [g for g in groups if len(g) >= 3]
    for at, sign in ((63, lambda c: c.attrs.get("class")), (73, _signature)):
        tops = [max(k.values()) for g in groups if (k := Counter(s for s in map(sign, g) if s is not None))]
        tops = [k for k in tops if k >= 3]
        x[at], x[at + 1] = max(tops, default=0), len(tops)
    x[65] = sum(body.count(c) for c in "$€£" if c in body)
    x[66] = t["img"] / (size / 1000) if size else 0
    used = sum(k > 0 for k in levels)
    x[67] = max(levels) / used if used else 0
    low = body.lower()
    x[68] = "breadcrumblist" in low
    texts = Counter(s for s in (_strip(n.content()).lower() for n in f.of("a")) if _bytes(s) > 3)
    x[69] = x[80] = sum(k >= 3 for k in texts.values())
    ratios = []
    for n in f.of("section", "article", "div"):
        k = _bytes(_strip(n.content()))
        if k > 50:
            ratios.append(sum(c.tag == "a" for c in n.walk()) / k * 1000)
    x[70] = float(np.var(ratios)) if len(ratios) >= 3 else 0
    x[71] = f.count('meta[name="robots"][content*="noindex"]') > 0
    x[72] = sum(bool(p) for p in path.split("/"))
    tokens = words(low)
    if tokens:
        counts = Counter(tokens)
        for i, group in enumerate((C.COMMERCIAL_WORDS, C.CONTENT_WORDS, C.TECH_WORDS, C.FORUM_WORDS)):
            x[75 + i] = sum(counts[w] for w in group) / len(tokens)
    x[79] = max(texts.values(), default=0)
    x[81] = f.count('meta[property="og:type"][content*="product.group"]') > 0
    for at, a, many in ((82, "filter", ("sidebar", "panel", "bar", "menu")), (83, "sort", ("select", "dropdown", "control", "option"))):
        x[at] = any(a in n.attrs["class"] and _any(n.attrs["class"], many) for n in f.classed)
    x[84] = _any(low, "0123456789") and _any(low, _COUNTED) and bool(_COUNT.search(low))
    cards = hits(e, ", ".join(f"[class*='{c}']" for c in ("product-card", "product-tile", "product-item", "product-grid-item", "grid-item", "collection-item")))
    price = compiled("[class*='price'], [class*='cost'], [class*='amount']")
    priced = sum(any(p(d) for d in c.walk() if d.kind == "element" for p in price) for c in cards)
    x[85], x[87], x[88] = priced, len(cards), priced / len(cards) if cards else 0
    x[86] = "collectionpage" in low or "productcollection" in low
    return x


def _signature(n: Node) -> str:
    cls = n.get("class").lower()
    # keywords in the order in which they are tried
    word = next((k for k in ("item", "card", "product", "post", "entry", "result", "row", "cell") if k in cls), "")
    return f"{n.tag}|{word}" if word else n.tag


# ------------------------------------------------------------- tf-idf and forest


@lru_cache(maxsize=1)
def page_model() -> dict:
    """Vocabulary (term: index, idf), feature means and scales, labels."""
    m = json.loads(get_data("pagemill", "data/page_model.json"))
    assert len(m["terms"]) == 100 and len(m["mean"]) == len(m["scale"]) == 89 and len(m["labels"]) == 7
    return m


_TOKENS = re.compile(r"\w{2,}")


def tokenize(text: str) -> list[str]:
    return [t for t in _TOKENS.findall(text.lower())]


def tfidf(text: str, terms: dict | None = None, size: int = 100) -> np.ndarray:
    terms = page_model()["terms"] if terms is None else terms
    x = np.zeros(size)
    for t in tokenize(text):
        if t in terms:
            x[terms[t][0]] += terms[t][1]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def title_and_description(f: Facts) -> str:
    n = next((e for e in f.elements if e.tag == "title"), None)
    description = next((f.meta[k] for k in ("description", "og:description", "twitter:description", "dc.description", "excerpt") if k in f.meta), "")
    return _strip(f"{_strip(n.content()) if n is not None else ''} {_strip(description)}")


def feature_vector(f: Facts, url: str | None) -> np.ndarray:
    """89 scaled features and 100 term weights."""
    m = page_model()
    mean, scale = np.array(m["mean"]), np.array(m["scale"])
    scaled = np.where(scale > 0, (features(f, url) - mean) / np.where(scale > 0, scale, 1), 0)
    return np.concatenate([scaled, tfidf(title_and_description(f))])


class Forest:
    """A gradient-boosted forest in XGBoost's JSON form."""

    def __init__(self, text: str):
        raw = json.loads(text)
        self.classes = int(raw["learner"]["learner_model_param"]["num_class"])
        model = raw["learner"]["gradient_booster"]["model"]
        self.owner = [int(c) for c in model["tree_info"]]
        if self.classes <= 0 or len(self.owner) != len(model["trees"]) or any(not 0 <= c < self.classes for c in self.owner):
            raise ValueError("trees and classes of the forest don't fit")
        self.trees = []
        for t in model["trees"]:
            arrays = [np.array(t[k]) for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left")]
            if len({len(a) for a in arrays}) != 1:
                raise ValueError("node arrays of a tree differ in length")
            self.trees.append(arrays)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[pages, classes]; splits compare 32-bit floats, strictly."""
        margins = np.zeros((len(x), self.classes))
        rows = np.arange(len(x))
        for (left, right, feature, cut, default), c in zip(self.trees, self.owner):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(left)):
                inner = left[node] >= 0
                if not inner.any():
                    break
                v = x[rows, np.minimum(feature[node], x.shape[1] - 1)]
                missing = np.isnan(v) | (feature[node] >= x.shape[1])
                go = np.where(missing, default[node].astype(bool), v.astype(np.float32) < cut[node].astype(np.float32))
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            margins[:, c] += np.where(left[node] < 0, cut[node], 0)
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def classify(doc: Node, url: str | None, forest: Forest | None = None) -> tuple[str, float | None]:
    """(page type, confidence).  Without a forest: the refined type and None."""
    f = Facts(doc)
    by_url = type_by_url(url)
    refined = refine(by_url, signals(f)) if by_url == "article" else by_url
    if forest is None:
        return refined, None
    p = forest.probabilities(feature_vector(f, url)[None])[0]
    label = page_model()["labels"][int(np.argmax(p))]
    if by_url != "article" and label == by_url:
        return by_url, 1.0
    if refined != "article" and label == refined:
        return refined, 0.95
    return label, float(p.max())
