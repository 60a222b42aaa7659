"""TF-IDF over a fixed vocabulary, relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..html.classify import page_model


def vocabulary(df: DataFrame) -> DataFrame:
    """``(term, idx, idf)``: 100 rows whatever the corpus, safe to broadcast."""
    rows = [(t, int(i), float(w)) for t, (i, w) in page_model()["terms"].items()]
    return df.sparkSession.createDataFrame(rows, "term string, idx int, idf double")


def tfidf(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, term, weight)``: tf times idf over each row's L2 norm; terms out of
    the vocabulary don't count, rows without any are left out."""
    tokens = df.select(key, F.explode(T.tokens(text)).alias("term"))
    counts = tokens.join(F.broadcast(vocabulary(df)), "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("idf").alias("idf"))
    raw = counts.select(key, F.struct("term", (F.col("tf") * F.col("idf")).alias("w")).alias("x"))
    lists = raw.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    norm = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return lists.withColumn("norm", norm).select(key, F.explode("xs").alias("x"), "norm").select(key, F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("weight"))
