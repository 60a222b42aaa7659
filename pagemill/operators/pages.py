"""Page operators: one Arrow pass over (url, html), parsed once a row.

Guards are columns: a row that may not be worked on gets an ``error`` and null
results, unless ``mode="FAILFAST"``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..html import classify as K
from ..html import extract as X
from ..html import metadata as M
from ..html import sanitize as S
from ..html.tree import parse

MAX_INPUT = 10 << 20
MODES = ("precision", "balanced", "recall", "keep")
METADATA_DDL = "struct<title:string,author:string,url:string,hostname:string,description:string,sitename:string,date:string,categories:array<string>,tags:array<string>,image:string,page_type:string,license:string>"
CLEAN_DDL = f"html string, messages array<struct<type:string,text:string>>, metadata {METADATA_DDL}, page_type string, confidence double"
EXTRACT_DDL = "content_html string, page_type string, confidence double, text_length long, fallback_used boolean, warnings array<string>"

_LIST = pa.list_(pa.string())
_META = pa.struct([(f, _LIST if f in ("categories", "tags") else pa.string()) for f in M.FIELDS])
_MESSAGES = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))


def guard(html: Column, max_input: int = MAX_INPUT) -> Column:
    """Why a row may not be worked on; null where it may."""
    return F.when(html.isNull(), F.lit("html must be a string")).when(F.octet_length(html) > max_input, F.lit(f"input exceeds {max_input} bytes"))


def admitted(df: DataFrame, html_col: str, max_input: int, mode: str) -> DataFrame:
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError("mode must be PERMISSIVE or FAILFAST")
    error = guard(F.col(html_col), max_input)
    if mode == "FAILFAST":
        return df.withColumn("error", F.when(error.isNotNull(), F.raise_error(error)).cast("string"))
    return df.withColumn("error", error)


def check_options(boilerplate: str, page_type: str | None, **toggles) -> None:
    if boilerplate not in MODES:
        raise ValueError(f"boilerplate must be one of {', '.join(MODES)}")
    if page_type is not None and page_type not in K.PAGE_TYPES:
        raise ValueError(f"page_type must be one of {', '.join(K.PAGE_TYPES)}")
    for name, v in toggles.items():
        if v is not None and not isinstance(v, bool):
            raise TypeError(f"{name} must be a boolean")


def _run(df: DataFrame, ddl: str, types: list[pa.DataType], one, html_col: str, url_col: str | None, only: Sequence[str] | None = None) -> DataFrame:
    """Appends the columns of ``ddl``; ``one(html, url)`` gives a row's values.

    An error of ``one`` becomes the row's ``error``.  ``only`` names the columns
    that come back from Python, of the old and the new ones; ``error`` always does.
    """
    extra = StructType.fromDDL(ddl)
    taken = {c.lower() for c in df.columns} - {"error"}
    names = []
    for f in extra.fields:
        while f.name.lower() in taken:
            f.name = "_" + f.name
        taken.add(f.name.lower())
        names.append(f.name)
    wanted = lambda name: only is None or name in only
    kept = [f.name for f in df.schema.fields if f.name != "error" and wanted(f.name)]
    chosen = [k for k, name in enumerate(names) if wanted(name)]
    schema = StructType([*(df.schema[c] for c in kept), *(extra.fields[k] for k in chosen), df.schema["error"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                htmls, errors = batch.column(html_col), batch.column("error").to_pylist()
                urls = batch.column(url_col).to_pylist() if url_col else [None] * len(htmls)
                rows = []
                for i, url in enumerate(urls):
                    row = [None] * len(types)
                    if errors[i] is None:
                        try:
                            row = one(htmls[i].as_py(), url)  # one page at a time: a batch may hold 64 MB of them
                        except Exception as e:  # a page must not end the job
                            errors[i] = f"{type(e).__name__}: {e}"
                    rows.append(row)
                cols = [pa.array([r[k] for r in rows], types[k]) for k in chosen]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols, pa.array(errors, pa.string())], names=[*kept, *(names[k] for k in chosen), "error"])
            whole = batch = htmls = None  # before the next batch is read

    return df.mapInArrow(run, schema)


def _forest(df: DataFrame, path: str | None):
    """A broadcast forest: its file is one model, whatever the table's size."""
    if path is None:
        return None
    with open(path) as f:
        return df.sparkSession.sparkContext.broadcast(K.Forest(f.read()))


def clean_one(html: str, url: str | None, boilerplate: str, rules: S.Config, minify: bool = False, page_type: str | None = None, blacklist: set[str] | None = None, forest: K.Forest | None = None, hardened: bool = False, bare_references: bool = True) -> list:
    """(html, messages, metadata, page type, confidence) of one page."""
    messages: list[dict] = []
    doc = parse(html, bare_references)
    try:
        meta = M.metadata(doc, url, blacklist) or None
    except Exception as e:
        meta = None
        messages.append({"type": "warning", "text": f"metadata extraction failed: {e}"})
    body, kind, confidence = html, None, None
    if boilerplate != "keep":
        try:
            kind, confidence = (page_type, None) if page_type else K.classify(doc, url, forest)
            got = X.rescue(html, X.extract_tree(doc, X.Options(focus=boilerplate, page_type=kind), confidence), bare_references)
            messages += [{"type": "warning", "text": f"boilerplate: {w}"} for w in got.warnings]
            if got.content_html:
                body = got.content_html
            else:
                messages.append({"type": "warning", "text": "boilerplate removal produced no content; cleaning the whole document"})
        except Exception as e:
            messages.append({"type": "warning", "text": f"boilerplate removal failed: {e}; cleaning the whole document"})
    return [S.clean_html(body, rules, minify, hardened, bare_references), messages, meta, kind, confidence]


def clean_pages(
    df: DataFrame,
    html_col: str = "html",
    url_col: str | None = "url",
    boilerplate: str = "balanced",
    include_images: bool | None = None,
    include_tables: bool | None = None,
    include_links: bool | None = None,
    include_comments: bool | None = None,
    minify: bool = False,
    config: dict | None = None,
    max_input_bytes: int = MAX_INPUT,
    page_type: str | None = None,
    author_blacklist: set[str] | None = None,
    forest_path: str | None = None,
    mode: str = "PERMISSIVE",
    hardened: bool = False,
    bare_references: bool = True,
) -> DataFrame:
    """``df`` with ``(html, messages, metadata, page_type, confidence, error)``.

    ``boilerplate`` chooses the focus of extraction, or ``keep`` for the whole
    document; where extraction gives nothing, the whole document is cleaned
    and a message says so.  New columns whose name is taken get underscores.
    Null html and html over ``max_input_bytes`` give an ``error`` and nulls;
    empty html gives empty html.  ``hardened`` sanitises by the stricter way.
    ``include_comments`` has no effect.  Without ``bare_references``, here as
    in the other operators, names need their semicolon (``tree.parse``).
    """
    check_options(boilerplate, page_type, include_images=include_images, include_tables=include_tables, include_links=include_links, include_comments=include_comments)
    rules = S.derive(S.Config.of(config) if config is not None else S.DEFAULT, include_images, include_tables, include_links)
    forest = _forest(df, forest_path)

    def one(html: str, url: str | None) -> list:
        return clean_one(html, url, boilerplate, rules, minify, page_type, author_blacklist, forest.value if forest else None, hardened, bare_references)

    rows = admitted(df, html_col, max_input_bytes, mode)
    return _run(rows, CLEAN_DDL, [pa.string(), _MESSAGES, _META, pa.string(), pa.float64()], one, html_col, url_col)


def clean_bytes(df: DataFrame, content_col: str = "content", **options) -> DataFrame:
    """``clean_pages`` of bytes of unknown encoding: the messages of decoding
    come before those of cleaning.  Undecodable bytes give null html, a message
    and an ``error``; other columns stay, the bytes go."""
    from ..sources.pages import decoded

    rows = decoded(df, content_col).withColumnRenamed("messages", "_decoding")
    out = clean_pages(rows, **options)
    name = next(c for c in reversed(out.columns) if c.strip("_") == "messages")
    return out.withColumn(name, F.concat("_decoding", F.coalesce(name, F.expr("array()")))).drop("_decoding")


def extract_pages(
    df: DataFrame,
    html_col: str = "html",
    url_col: str | None = "url",
    focus: str = "balanced",
    page_type: str | None = None,
    include_links: bool = True,
    include_images: bool = True,
    exclude_tables: bool = False,
    emit: str = "preserve",
    forest_path: str | None = None,
    max_input_bytes: int = MAX_INPUT,
    mode: str = "PERMISSIVE",
    only: Sequence[str] | None = None,
    bare_references: bool = True,
) -> DataFrame:
    """``df`` with ``(content_html, page_type, confidence, text_length,
    fallback_used, warnings, error)``: the main content, not sanitised.
    ``only`` names those columns, old and new, that are wanted."""
    check_options(focus, page_type)
    forest = _forest(df, forest_path)

    def one(html: str, url: str | None) -> list:
        doc = parse(html, bare_references)
        kind, confidence = (page_type, None) if page_type else K.classify(doc, url, forest.value if forest else None)
        o = X.Options(focus, kind, include_images, include_links, exclude_tables, emit)
        e = X.rescue(html, X.extract_tree(doc, o, confidence), bare_references)
        return [e.content_html, e.page_type, e.confidence, e.text_length, e.fallback_used, e.warnings]

    rows = admitted(df, html_col, max_input_bytes, mode)
    return _run(rows, EXTRACT_DDL, [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), _LIST], one, html_col, url_col, only)


def page_summary(df: DataFrame, html_col: str = "html", url_col: str | None = "url", max_input_bytes: int = MAX_INPUT, mode: str = "PERMISSIVE", only: Sequence[str] | None = None, bare_references: bool = True) -> DataFrame:
    """``df`` with ``(page_type, text_length, metadata, error)``: extraction and
    metadata from one parse of each page."""

    def one(html: str, url: str | None) -> list:
        doc = parse(html, bare_references)
        meta = M.metadata(doc, url)
        kind, confidence = K.classify(doc, url)
        e = X.rescue(html, X.extract_tree(doc, X.Options(page_type=kind), confidence), bare_references)
        return [e.page_type, e.text_length, meta]

    return _run(admitted(df, html_col, max_input_bytes, mode), f"page_type string, text_length long, metadata {METADATA_DDL}", [pa.string(), pa.int64(), _META], one, html_col, url_col, only)


def page_metadata(
    df: DataFrame, html_col: str = "html", url_col: str | None = "url", author_blacklist: set[str] | None = None, max_input_bytes: int = MAX_INPUT, mode: str = "PERMISSIVE", only: Sequence[str] | None = None, bare_references: bool = True
) -> DataFrame:
    """``df`` with ``(metadata, error)``, or those columns that ``only`` names."""

    def one(html: str, url: str | None) -> list:
        return [M.metadata(parse(html, bare_references), url, author_blacklist)]

    return _run(admitted(df, html_col, max_input_bytes, mode), f"metadata {METADATA_DDL}", [_META], one, html_col, url_col, only)


SIGNALS_DDL = "signals struct<og_type:string,ld_types:array<string>,aggregate_offer:boolean,add_to_cart:boolean,product_grid:boolean,product_elements:long,pagination:boolean,code_blocks:long,docs_nav:boolean,link_ratio:double,paragraph_words:long>, refined_type string"
_SIGNALS = pa.struct(
    [("og_type", pa.string()), ("ld_types", _LIST), *((k, pa.bool_()) for k in ("aggregate_offer", "add_to_cart", "product_grid")), ("product_elements", pa.int64()), ("pagination", pa.bool_()), ("code_blocks", pa.int64()), ("docs_nav", pa.bool_()), ("link_ratio", pa.float64()), ("paragraph_words", pa.int64())]
)


def page_signals(df: DataFrame, html_col: str = "html", url_col: str | None = "url", max_input_bytes: int = MAX_INPUT, mode: str = "PERMISSIVE", only: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``(signals, refined_type, error)``."""

    def one(html: str, url: str | None) -> list:
        s = K.signals(K.Facts(parse(html)))
        return [s, K.refine(K.type_by_url(url), s)]

    return _run(admitted(df, html_col, max_input_bytes, mode), SIGNALS_DDL, [_SIGNALS, pa.string()], one, html_col, url_col, only)


def page_features(df: DataFrame, html_col: str = "html", url_col: str | None = "url", scaled: bool = False, max_input_bytes: int = MAX_INPUT, mode: str = "PERMISSIVE", only: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``(features, error)``: the 89 numbers, or with ``scaled`` the
    189 that a forest reads."""

    def one(html: str, url: str | None) -> list:
        facts = K.Facts(parse(html))
        return [(K.feature_vector if scaled else K.features)(facts, url).tolist()]

    return _run(admitted(df, html_col, max_input_bytes, mode), "features array<double>", [pa.list_(pa.float64())], one, html_col, url_col, only)


NODES_DDL = "nodes array<struct<nid:int,pid:int,last:int,depth:int,sib:int,is_last_elem:boolean,kind:string,tag:string,attrs:map<string,string>,text:string>>"
_NODES = pa.list_(
    pa.struct(
        [("nid", pa.int32()), ("pid", pa.int32()), ("last", pa.int32()), ("depth", pa.int32()), ("sib", pa.int32()), ("is_last_elem", pa.bool_()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
    )
)


def node_rows(html: str, bare_references: bool = True) -> list[dict]:
    """The tree in pre-order; ``last`` is the greatest id below a node."""
    out: list[dict] = []
    stack = [(parse(html, bare_references), -1, -1, 0, False)]
    while stack:
        n, pid, depth, sib, last = stack.pop()
        nid = len(out)
        out.append({"nid": nid, "pid": pid, "last": nid, "depth": depth + 1, "sib": sib, "is_last_elem": last, "kind": n.kind, "tag": n.tag if n.kind == "element" else None, "attrs": list(n.attrs.items()) if n.kind == "element" else [], "text": n.text if n.kind != "element" and n.kind != "document" else None})
        tail = next((c for c in reversed(n.children) if c.kind == "element"), None)
        stack += [(c, nid, depth + 1, i, c is tail) for i, c in enumerate(n.children)][::-1]
    for r in reversed(out):
        if r["pid"] >= 0:
            p = out[r["pid"]]
            p["last"] = max(p["last"], r["last"])
    return out


def page_nodes(df: DataFrame, html_col: str = "html", max_input_bytes: int = MAX_INPUT, mode: str = "PERMISSIVE", only: Sequence[str] | None = None, bare_references: bool = True) -> DataFrame:
    """``df`` with ``(nodes, error)``: each page's tree as one array."""
    return _run(admitted(df, html_col, max_input_bytes, mode), NODES_DDL, [_NODES], lambda html, _: [node_rows(html, bare_references)], html_col, None, only)


def node_table(df: DataFrame, key: str = "page_id", html_col: str = "html", bare_references: bool = True) -> DataFrame:
    """One row a node: ``(key, nid, pid, last, ...)``."""
    return page_nodes(df.select(key, html_col), html_col, only=(key, "nodes"), bare_references=bare_references).select(key, F.explode("nodes").alias("n")).select(key, "n.*")


def result_json(df: DataFrame) -> Column:
    """A clean result as JSON text; fields without a value are left out."""
    return F.to_json(F.struct("html", "metadata", F.col("page_type").alias("pageType"), "confidence", "messages"))


def parse_result(c: Column) -> Column:
    return F.from_json(c, CLEAN_DDL.replace("page_type string, confidence", "pageType string, confidence"), {"mode": "PERMISSIVE"})


def load_config(path: str) -> dict:
    """A custom cleaning configuration; says which of reading, parsing and
    validating failed."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except OSError as e:
        raise ValueError(f"cannot read config: {e}") from e
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ValueError(f"config is not valid JSON: {e}") from e
    error = S.config_error(raw)
    if error:
        raise ValueError(f"invalid config: {error}")
    return raw
