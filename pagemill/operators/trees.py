"""Relational operators over the node table: descendants are id ranges.

Each works inside a page, so everything is grouped or joined on the page key
first; aggregates combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def tag_counts(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    return elements(nodes).groupBy(key, "tag").agg(F.count("*").alias("n"))


def descendants(above: DataFrame, below: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs (a, d) of nodes of one page, d under a."""
    a = above.select(key, F.struct(*[c for c in above.columns if c != key]).alias("a"))
    d = below.select(key, F.struct(*[c for c in below.columns if c != key]).alias("d"))
    return a.join(d, key).where("d.nid > a.nid and d.nid <= a.last")


def text_of(above: DataFrame, nodes: DataFrame, key: str = "page_id", sep: str = "") -> DataFrame:
    """``(key, nid, text)``: the text under each node, in document order."""
    texts = nodes.where("kind = 'text'").select(key, "nid", "text")
    pairs = descendants(above.select(key, "nid", "last"), texts, key)
    return pairs.groupBy(key, F.col("a.nid").alias("nid")).agg(F.sort_array(F.collect_list(F.struct("d.nid", "d.text"))).alias("parts")).select(
        key, "nid", F.array_join(F.col("parts.text"), sep).alias("text")
    )


def text_under(page_nodes: DataFrame, tag: str, key: str = "page_id", sep: str = "") -> DataFrame:
    """``(key, nid, text)`` of each element ``tag``, from pages with their nodes
    as one array: no shuffle, and pages are parsed once."""
    texts = F.filter("nodes", lambda n: n["kind"] == "text")
    own = F.filter("nodes", lambda n: n["tag"] == tag)
    both = page_nodes.select(key, own.alias("own"), texts.alias("texts")).select(key, F.explode("own").alias("n"), "texts")
    under = F.filter("texts", lambda t: (t["nid"] > F.col("n.nid")) & (t["nid"] <= F.col("n.last")))
    return both.select(key, F.col("n.nid").alias("nid"), F.array_join(F.transform(under, lambda t: t["text"]), sep).alias("text"))


def first_match(nodes: DataFrame, test: Column, key: str = "page_id") -> DataFrame:
    """The first element of each page, in document order, that passes."""
    return elements(nodes).where(test).groupBy(key).agg(F.min_by(F.struct(*[c for c in nodes.columns if c != key]), "nid").alias("n")).select(key, "n.*")


def without(nodes: DataFrame, victims: DataFrame, key: str = "page_id") -> DataFrame:
    """``nodes`` less the subtrees of ``victims``: an anti range-join."""
    v = victims.select(F.col(key).alias("_k"), F.col("nid").alias("_lo"), F.col("last").alias("_hi"))
    return nodes.join(v, (F.col(key) == F.col("_k")) & F.col("nid").between(F.col("_lo"), F.col("_hi")), "left_anti")


def link_stats(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, links, hrefs)``: anchors, and distinct targets among them."""
    a = elements(nodes).where("tag = 'a'")
    return a.groupBy(key).agg(F.count("*").alias("links"), F.count_distinct(F.col("attrs")["href"]).alias("hrefs"))


def heading_levels(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    h = elements(nodes).where(F.col("tag").rlike("^h[1-6]$"))
    return h.groupBy(key).pivot("tag", [f"h{k}" for k in range(1, 7)]).agg(F.count(F.lit(1))).na.fill(0)


def last_sibling(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``nodes`` of elements with ``is_last``: no element sibling follows."""
    w = Window.partitionBy(key, "pid").orderBy("nid")
    return elements(nodes).withColumn("is_last", F.lead("nid").over(w).isNull())


def meta_map(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, name, content)``: the first content of each meta name."""
    name = F.lower(F.coalesce(*[F.nullif(F.col("attrs")[k], F.lit("")) for k in ("name", "property", "itemprop", "http-equiv")]))
    m = elements(nodes).where("tag = 'meta'").select(key, "nid", name.alias("name"), F.col("attrs")["content"].alias("content"))
    return m.where("name <> '' and content <> ''").groupBy(key, "name").agg(F.min_by("content", "nid").alias("content"))


def holding(above: DataFrame, below: DataFrame, key: str = "page_id") -> DataFrame:
    """Those of ``above`` that have one of ``below`` under them: a semi range-join."""
    b = below.select(F.col(key).alias("_k"), F.col("nid").alias("_n"))
    return above.join(b, (F.col(key) == F.col("_k")) & (F.col("_n") > F.col("nid")) & (F.col("_n") <= F.col("last")), "left_semi")


def first_by_rank(nodes: DataFrame, tests: list[Column], key: str = "page_id") -> DataFrame:
    """Of each page, the first element that passes the earliest test any passes."""
    rank = F.coalesce(*(F.when(t, F.lit(k)) for k, t in enumerate(tests)))
    w = Window.partitionBy(key).orderBy("_rank", "nid")
    return elements(nodes).withColumn("_rank", rank).where("_rank is not null").withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_rank", "_at")


def repeated_links(nodes: DataFrame, least: int = 3, key: str = "page_id") -> DataFrame:
    """``(key, text, n)``: link texts of over 3 bytes seen ``least`` times."""
    found = text_of(elements(nodes).where("tag = 'a'"), nodes, key).select(key, F.lower(F.trim("text")).alias("text"))
    return found.where(F.octet_length("text") > 3).groupBy(key, "text").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def link_variance(nodes: DataFrame, block: Column, key: str = "page_id") -> DataFrame:
    """``(key, variance)``: population variance of the links under each block."""
    blocks = elements(nodes).where(block).select(key, "nid", "last")
    links = elements(nodes).where("tag = 'a'").select(F.col(key).alias("_k"), F.col("nid").alias("_n"))
    held = blocks.join(links, (F.col(key) == F.col("_k")) & (F.col("_n") > F.col("nid")) & (F.col("_n") <= F.col("last")), "left")
    return held.groupBy(key, "nid").agg(F.count("_n").alias("n")).groupBy(key).agg(F.var_pop("n").alias("variance"))


def class_hits(nodes: DataFrame, parts: tuple[str, ...], key: str = "page_id") -> DataFrame:
    """``(key, nid, part)``: elements with a class that contains a part, once
    for each part."""
    classed = elements(nodes).where(F.col("attrs")["class"].isNotNull())
    return classed.select(key, "nid", F.explode(F.filter(F.array(*map(F.lit, parts)), lambda p: F.contains(F.col("attrs")["class"], p))).alias("part"))


def last_before(nodes: DataFrame, test: Column, value: Column, name: str, key: str = "page_id") -> DataFrame:
    """Elements with ``name``: the ``value`` of the last one before that passes."""
    w = Window.partitionBy(key).orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    return elements(nodes).withColumn(name, F.last(F.when(test, value), ignorenulls=True).over(w))


def levels(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, nid, level)``, from the roots (``pid`` -1) down; nodes that no
    root reaches are left out.

    Each page is walked whole, in one Arrow pass after one shuffle: a recursive
    query ends at a million rows of the table or at 100 levels, and computes
    ``nodes`` again for every level.
    """
    walked = StructType([nodes.schema[key], nodes.schema["nid"], StructField("level", IntegerType())])
    nid = to_arrow_type(walked["nid"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = batch.column("nodes")
                ends = pc.list_value_length(lists).to_numpy(zero_copy_only=False).cumsum().tolist()
                nids, pids = (lists.flatten().field(k).to_pylist() for k in (0, 1))
                rows, ids, depths, at = [], [], [], 0
                for i, end in enumerate(ends):
                    found = _walk(nids[at:end], pids[at:end])
                    rows += [i] * len(found)
                    ids += [n for n, _ in found]
                    depths += [d for _, d in found]
                    at = end
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), pa.array(ids, nid), pa.array(depths, pa.int32())], names=walked.names)

    return nodes.groupBy(key).agg(F.collect_list(F.struct("nid", "pid")).alias("nodes")).mapInArrow(run, walked)


def _walk(nids: list[int], pids: list[int]) -> list[tuple[int, int]]:
    """(node, level) of those nodes that a root reaches, each row once."""
    below: dict[int, list[int]] = {}
    for n, p in zip(nids, pids):
        below.setdefault(p, []).append(n)
    out, level, depth = [], below.pop(-1, []), 0
    while level:
        out += [(n, depth) for n in level]
        level, depth = [c for n in level for c in below.pop(n, ())], depth + 1
    return out


def page_nodes_of(spark, sf_dir: str, bare_references: bool = True) -> DataFrame:
    """The node table of the pages of ``sf_dir``."""
    from ..sources.pages import pages, spread
    from .pages import node_table

    return node_table(spread(pages(spark, sf_dir)), bare_references=bare_references)
