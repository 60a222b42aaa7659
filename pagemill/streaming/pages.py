"""Pages as a stream: every page is independent, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.pages import clean_pages
from ..sources.pages import PAGES


def page_stream(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).parquet(path)


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """One HTML file a row, as column ``html``."""
    return spark.readStream.text(path, wholetext=True).withColumnRenamed("value", "html")


def clean_stream(stream: DataFrame, out: str, checkpoint: str, **options):
    """Starts a query that cleans what is there and stops; run again for more."""
    return clean_pages(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
