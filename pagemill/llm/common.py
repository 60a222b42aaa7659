"""Shared machinery: Arrow batch walking, vectorised tokens, stored tables.

Everything here is size-independent: kernels see one Arrow batch at a time and
cut it into pieces of bounded bytes, and tables that are read twice are stored
in the folder that all executors share (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import atexit
import ctypes
import logging
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_LOG = logging.getLogger(__name__)
PIECE_BYTES = 1 << 20

# --------------------------------------------------------------- stored tables


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, one of this
    machine in local mode, as in tests; on a cluster that is an error, for its
    machines don't share such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_STORED: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    _STORED.pop(path, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_stored() -> None:
    """Delete all tables that operators stored in this session, once their
    results have been read: a driver that lives on calls this between jobs."""
    left = []
    for path, spark in list(_STORED.items()):
        if spark.sparkContext._jsc is None:  # its session has ended
            left.append(_STORED.pop(path) and path)
            continue
        try:
            _delete(spark, path)
        except Exception as e:  # the gateway may be gone at interpreter exit
            left.append(f"{path} ({e})")
    if left:
        _LOG.warning("%d stored tables are left, such as %s", len(left), left[0])


atexit.register(clear_stored)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a re-run.
    The files go with ``clear_stored`` or when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagemill-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _STORED[path] = spark
    back = spark.read.schema(schema).parquet(path)
    back._stored_path = path
    return back


def tidy(kernel):
    """``kernel``, giving freed memory back to the system when its task ends:
    Python workers live on, and executors count them."""

    def run(batches):
        yield from kernel(batches)
        release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def drop_stored(*tables: DataFrame) -> None:
    for df in tables:
        _delete(df.sparkSession, df._stored_path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


BUCKET_BYTES = 32 << 20


def buckets_for(spark: SparkSession, n_bytes: int = 0) -> int:
    """Buckets for ``n_bytes`` of rows that are grouped whole in Python workers:
    each of some ``BUCKET_BYTES``, and several a partition, so that partitions
    come out even."""
    return max(4 * shuffle_partitions(spark), min(n_bytes // BUCKET_BYTES, 1 << 20))


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a table's bytes; 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 56 else 0


# ------------------------------------------------------------------ text bytes


def text_views(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of a string or binary array, without a copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    null = np.zeros(n, bool) if col.null_count == 0 else np.asarray(col.is_null())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0], null


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 0xFFFF)
        yield lo, hi
        lo = hi


# Spaces, control and ASCII punctuation part words; letters, digits and bytes
# of multi-byte characters make them.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, on UTF-8 bytes."""
    low = _LOWER[buf]
    lead = np.flatnonzero(low[:-1] == 0xC3) if len(low) > 1 else np.zeros(0, np.int64)
    if len(lead):
        nxt = low[lead + 1]
        up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        low[up] += 0x20
    return low


def word_mask(buf: np.ndarray) -> np.ndarray:
    """True on word bytes; general punctuation and Latin-1 signs part words too."""
    w = _WORD[buf]
    for lead, n in ((0xC2, 2), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(buf == lead)
        if not len(at):
            continue
        at = at[at + n <= len(buf)]
        if lead != 0xC2:
            second = buf[at + 1]
            at = at[(second == 0x80) | (second == 0x81)] if lead == 0xE2 else at[second == 0x80]
        for k in range(n):
            w[at + k] = False
    return w


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, PIECE_BYTES + 4096)
        for name, base in (("p", _P), ("i", _P_INV)):
            powers = np.full(size, base, U64)
            powers[0] = 1
            _POW[name] = powers.cumprod(dtype=U64)
    return _POW["p"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def span_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by one pass of prefix sums over the bytes."""
    p, inv = _powers(len(low) + 1)
    s = np.empty(len(low) + 1, U64)
    s[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * p[:-1], dtype=U64, out=s[1:])
    return mix((s[ends] - s[starts]) * inv[starts])


class Words:
    """The words of some texts: byte spans, hashes, and each text's first word."""

    __slots__ = ("low", "buf", "starts", "ends", "hash", "first", "doc")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        off = offsets - offsets[0]
        self.buf, self.low = buf, fold(buf)
        w = word_mask(buf)
        n = len(buf)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
            edge = off[(off > 0) & (off < n)]
            before[edge] = False
            after[edge - 1] = False
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.hash = span_hash(self.low, self.starts, self.ends) if n else np.zeros(0, U64)
        self.first = np.searchsorted(self.starts, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


def each_piece(col: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Words of bounded row ranges of a text column: (first row, past last, words)."""
    buf, off, _ = text_views(col)
    for lo, hi in pieces(off, most):
        yield lo, hi, Words(buf[off[lo] : off[hi]], off[lo : hi + 1])


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values (length len(h)-k+1; empty if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)


def windows_inside(first: np.ndarray, k: int) -> np.ndarray:
    """Start positions whose run of k words stays within one text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return np.flatnonzero(ok)


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds values[cuts[i]:cuts[i+1]]."""
    width = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unblob(col: pa.Array, dtype, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``blobs``: all values, and the number in each row."""
    buf, off, _ = text_views(col)
    size = np.dtype(dtype).itemsize * width
    values = np.frombuffer(buf.tobytes(), dtype)
    return (values.reshape(-1, width) if width > 1 else values), np.diff(off) // size


def routed(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets present, and the cuts between them."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 65536 else bucket, kind="stable")
    b = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return order, b[at], np.concatenate([at, [len(b)]]).astype(np.int64)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
