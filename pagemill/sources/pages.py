"""Where pages come from and where results go."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PAGES = "page_id long, url string, html string"
LEAST_CONFIDENCE = 0.2
SMALL = 16 << 20


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A bare scan, cut into as many parts as there are cores where its files
    are small: page kernels cost milliseconds a row, a shuffle of the rows far
    less, and a row group is not split however many parts a file has.  Large
    tables have more row groups than there are cores and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(cores) if size < cores * SMALL or scan.rdd.getNumPartitions() < cores else scan


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, html)``: one UTF-8 file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def byte_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, html, messages)``: files of unknown encoding, decoded."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"), "content")


def bom_encoding(content: Column) -> Column:
    """The encoding that a byte order mark names; null without one."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), "utf-8")
        .when(head == "FFFE0000", "utf-32-le")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head == "0000FEFF", "utf-32-be")
        .when(head.startswith("FEFF"), "utf-16-be")
    )


def decoded(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``html`` and ``messages`` in place of the bytes ``column``.

    Empty bytes are empty text; then a byte order mark decides, then valid
    UTF-8, which stay in the JVM; only the rest is guessed in Python, and is
    null with a message where no guess is good enough.
    """
    c = F.col(column)
    bom = bom_encoding(c)
    easy = (
        F.when(F.octet_length(c) == 0, "")
        .when(bom == "utf-8", F.decode(F.expr(f"substring({column}, 4)"), "UTF-8"))
        .when(bom == "utf-16-le", F.decode(F.expr(f"substring({column}, 3)"), "UTF-16LE"))
        .when(bom == "utf-16-be", F.decode(F.expr(f"substring({column}, 3)"), "UTF-16BE"))
        .when(bom.isNull() & F.is_valid_utf8(c.cast("string")), c.cast("string"))
    )
    rows = df.withColumn("html", easy)
    kept = [f for f in rows.schema.fields if f.name not in (column, "html")]
    schema = StructType([*kept, StructField("html", StringType()), StructField("messages", StructType.fromDDL("m array<struct<type:string,text:string>>")["m"].dataType)])
    kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))

    def guess(batches):
        for b in batches:
            html, messages = b.column("html").to_pylist(), []
            for i, raw in enumerate(b.column(column).to_pylist()):
                said: list[dict] = []
                if html[i] is None and raw is not None:
                    html[i], said = _guess(raw)
                messages.append(said)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(html, pa.string()), pa.array(messages, kind)], names=[*(f.name for f in kept), "html", "messages"])

    return rows.mapInArrow(guess, schema)


def _guess(raw: bytes) -> tuple[str | None, list[dict]]:
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be")):
        if raw.startswith(mark):
            return raw[4:].decode(name, "replace"), []
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return raw.decode("windows-1252", "replace"), [{"type": "warning", "text": "no detector: decoded as windows-1252"}]
    best = from_bytes(raw).best()
    if best is None or 1 - best.chaos < LEAST_CONFIDENCE:
        return None, [{"type": "error", "text": "could not detect the encoding"}]
    return str(best), [{"type": "info", "text": f"decoded as {best.encoding}"}]


def write_html(df: DataFrame, path: str, column: str = "html") -> None:
    df.select(column).write.mode("overwrite").text(path, lineSep="\n\x00")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; fields without a value are left out."""
    from ..operators.pages import result_json

    df.select(result_json(df).alias("value")).write.mode("overwrite").text(path)


def diagnostics(df: DataFrame) -> DataFrame:
    """``(type, text, n)``: how often each message was given."""
    return df.select(F.explode("messages").alias("m")).groupBy("m.type", "m.text").agg(F.count("*").alias("n"))
