"""Relational queries over the node table: semi-joins, ranks, groups with a
condition, variances, unions, reports and walks, on generated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..operators.pages import node_table
from .cases import _generated
from .registry import COUNT, HOST, query

_K = "(SELECT page_id, page_id AS k FROM pages)"


def _nodes(spark: SparkSession, sf_dir: str, *parts: tuple[str, str]) -> DataFrame:
    return node_table(_generated(spark, sf_dir, list(parts)))


@query(f"SELECT page_id, 'li' AS tag, k % 4 AS n FROM {_K} WHERE k % 4 > 0 UNION ALL SELECT page_id, 'ul', CAST(1 AS BIGINT) FROM {_K} WHERE k % 4 > 0 UNION ALL SELECT page_id, 'p', k % 3 FROM {_K} WHERE k % 3 > 0")
def elements_with_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, items and paragraphs that hold a link: a semi range-join."""
    nodes = _nodes(spark, sf_dir, ("<ul>", "1"), ("<li><b><a>x</a></b></li>", "k % 4"), ("<li>y</li>", "k % 5"), ("</ul>", "1"), ("<p><a>z</a></p>", "k % 3"), ("<p>w</p>", "2"))
    held = trees.holding(nodes.where("tag in ('ul', 'li', 'p')"), nodes.where("tag = 'a'"))
    return held.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, CASE WHEN k % 3 > 0 THEN 'h1' WHEN k % 2 > 0 THEN 'h2' ELSE 'p' END AS tag FROM {_K}")
def ranked_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of the highest level there is, else the paragraph."""
    nodes = _nodes(spark, sf_dir, ("<p>t</p>", "1"), ("<h2>b</h2>", "k % 2"), ("<h1>a</h1>", "k % 3"))
    return trees.first_by_rank(nodes, [F.col("tag") == t for t in ("h1", "h2", "p")]).select("page_id", "tag")


@query(f"SELECT page_id, 'same text' AS text, k % 5 AS n FROM {_K} WHERE k % 5 >= 3 UNION ALL SELECT page_id, 'other', k % 4 FROM {_K} WHERE k % 4 >= 3")
def repeated_link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.repeated_links(_nodes(spark, sf_dir, ("<a>Same <b>text</b></a>", "k % 5"), ("<a> Other </a>", "k % 4"), ("<a>abc</a>", "9")))


@query(f"SELECT page_id, round((SELECT var_pop(v) FROM (SELECT unnest([k % 3, k % 4, k % 5]) AS v)), 9) AS variance FROM {_K}")
def link_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [x for n in (3, 4, 5) for x in (("<section>", "1"), ("<a>z</a>", f"k % {n}"), ("</section>", "1"))]
    v = trees.link_variance(_nodes(spark, sf_dir, *parts), F.col("tag") == "section")
    return v.select("page_id", F.round("variance", 9).alias("variance"))


@query(f"SELECT page_id, 'grid' AS part, k % 3 + k % 4 AS n FROM {_K} WHERE k % 3 + k % 4 > 0 UNION ALL SELECT page_id, 'card', k % 4 + k % 5 FROM {_K} WHERE k % 4 + k % 5 > 0")
def class_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements once for each part their class has: a union of all."""
    nodes = _nodes(spark, sf_dir, ('<i class="grid"></i>', "k % 3"), ('<i class="card-grid"></i>', "k % 4"), ('<i class="card"></i>', "k % 5"))
    return trees.class_hits(nodes, ("grid", "card")).groupBy("page_id", "part").agg(F.count("*").alias("n"))


_REPORTED = {"p": 3, "li": 4, "h1": 4}


@query(
    f"SELECT hostname, tag, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT coalesce({HOST}, 'none') AS hostname, '{t}' AS tag, {COUNT.format(f'<{t}>', k)} AS n FROM pages" for t, k in _REPORTED.items()) + ") GROUP BY ROLLUP (hostname, tag)"
)
def tag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by host and tag, with subtotals and a total."""
    from ..functions import urls as U
    from ..sources.pages import pages

    hosts = pages(spark, sf_dir).select("page_id", F.coalesce(U.hostname(F.col("url")), F.lit("none")).alias("hostname"))
    counts = trees.tag_counts(trees.page_nodes_of(spark, sf_dir)).where(F.col("tag").isin(*_REPORTED))
    return hosts.join(counts, "page_id").rollup("hostname", "tag").agg(F.sum("n").alias("n"))


@query(f"SELECT page_id, 'both' AS found FROM {_K} WHERE k % 2 > 0 AND k % 3 > 0 UNION ALL SELECT page_id, 'first only' FROM {_K} WHERE k % 2 > 0 AND k % 3 = 0 UNION ALL SELECT page_id, 'any' FROM {_K} WHERE k % 2 > 0 OR k % 3 > 0")
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the classes they have: intersection, difference and union."""
    nodes = _nodes(spark, sf_dir, ('<i class="hero"></i>', "k % 2"), ('<i class="card"></i>', "k % 3"))
    hero, card = (nodes.where(F.col("attrs")["class"] == c).select("page_id") for c in ("hero", "card"))
    named = lambda df, s: df.select("page_id", F.lit(s).alias("found"))
    return named(hero.intersect(card), "both").union(named(hero.subtract(card), "first only")).union(named(hero.union(card).distinct(), "any"))


@query(f"SELECT page_id, NULL AS heading, k % 3 AS n FROM {_K} WHERE k % 3 > 0 UNION ALL SELECT page_id, 'h2', k % 4 FROM {_K} WHERE k % 4 > 0 UNION ALL SELECT page_id, 'h3', k % 5 FROM {_K} WHERE k % 5 > 0")
def paragraphs_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs under the heading that came last before them: an as-of join."""
    nodes = _nodes(spark, sf_dir, ("<p>x</p>", "k % 3"), ("<h2>A</h2>", "1"), ("<p>y</p>", "k % 4"), ("<h3>B</h3>", "1"), ("<p>z</p>", "k % 5"))
    found = trees.last_before(nodes, F.col("tag").rlike("^h[1-6]$"), F.col("tag"), "heading").where("tag = 'p'")
    return found.groupBy("page_id", "heading").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, 3 + k % 5 AS levels FROM {_K}")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest level of each page, by a walk from parents to children."""
    return trees.levels(_nodes(spark, sf_dir, ("<div>", "k % 5"), ("x", "1"), ("</div>", "k % 5"))).groupBy("page_id").agg(F.max("level").cast("long").alias("levels"))


@query(f"SELECT page_id, CAST(least(1, k % 3) + least(1, k % 4) + least(1, k % 5) AS BIGINT) AS last_items FROM {_K} WHERE k % 3 + k % 4 + k % 5 > 0")
def last_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items that no element follows: one for each list that has any."""
    parts = [x for n in (3, 4, 5) for x in (("<ul>", "1"), ("<li>a</li>", f"k % {n}"), ("</ul>", "1"))]
    items = trees.last_sibling(_nodes(spark, sf_dir, *parts)).where("tag = 'li' and is_last")
    return items.groupBy("page_id").agg(F.count("*").alias("last_items"))


@query(f"SELECT page_id, CASE WHEN k % 2 = 1 THEN 'a' ELSE 'b' END AS name, CASE WHEN k % 2 = 1 THEN 'one' ELSE 'two' END AS content FROM {_K}")
def first_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir, ('<meta name="a" content="one">', "k % 2"), ('<meta name="b" content="two">', "1 + k % 3"))
    return trees.first_match(nodes, F.col("tag") == "meta").select("page_id", F.col("attrs")["name"].alias("name"), F.col("attrs")["content"].alias("content"))


@query(f"SELECT page_id, 'description' AS name, CASE WHEN k % 2 = 1 THEN 'D' ELSE 'E' END AS content FROM {_K} UNION ALL SELECT page_id, 'og:type', 'T' FROM {_K} WHERE k % 3 > 0")
def meta_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first content of each meta name; empty ones are passed over."""
    parts = [('<meta name="Description" content="">', "1"), ('<meta name="description" content="D">', "k % 2"), ('<meta name="" itemprop="description" content="E">', "1"), ('<meta property="OG:TYPE" content="T">', "k % 3")]
    return trees.meta_map(_nodes(spark, sf_dir, *parts))
