"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` edges of longs to ``(id, root)``, root the least id reached.

    Large-star and small-star steps alternate until no edge changes; the
    number of rounds grows with the logarithm of the longest chain.  Each round
    is stored in the shared folder, so lineage stays one round long.  Ids equal
    to their root are left out; an empty table gives an empty table.
    """
    now = stored(_tidy(edges.select("a", "b")), "edges")
    while True:
        nxt = stored(_small_star(_large_star(now)), "edges")
        before, after = _sign(now), _sign(nxt)
        drop_stored(now)
        now = nxt
        if before == after:
            return now.select(F.col("b").alias("id"), F.col("a").alias("root"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(low, "b").select(F.col("m").alias("root"), "a", "b")
    return joined.select(F.explode(F.array("a", "b")).alias("b"), F.col("root").alias("a")).where("a <> b").select("a", "b").distinct()
