"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over what its predecessor
kept.  All but the last return the columns of their ``docs`` (those of
``documents``: doc_id, text, lang, source, n_chars), extra ones too, in their
order; names that stages use inside may occur among them.  An empty table gives
an empty one in every stage; repeated rows are each treated like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, decontaminate, langid, pii, simhash
from pagemill.llm.common import free_name, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; ``lang`` becomes the language found.

    Rows with a null or empty text, or one without words, are in no language
    and go; a null ``lang`` teaches nothing and is filled; rows with a null
    doc_id stay if their text has a language.  Long texts are read whole.
    """
    name = free_name(docs, "found")
    found = langid.labelled_rows(docs).where(F.col(name) != langid.UND)
    return found.select(*(F.col(name).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of least id.

    Rows that share an id are one document and stay or go together; rows with
    a null id or text are in no group and stay; texts without words, empty ones
    too, are copies of each other.
    """
    gone = simhash.near_duplicates(docs).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.

    Rows that share an id go together if one of them does; rows with a null id
    or text, and empty texts, stay; items with a null id or text are not looked for.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontaminate.contamination(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text.

    All rows stay; a null text stays null with a null n_chars, an empty one
    has n_chars 0; ids are not looked at.
    """
    return pii.redacted_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, exact)``: token ids, checked by decoding them.

    A null text has null ids, an empty one none; a null doc_id stays null;
    other columns are dropped.
    """
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
