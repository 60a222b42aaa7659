"""Character language model with deleted interpolation, of bounded size.

The query scores with ``wordlm``, whose counts grow with the corpus.

A character n-gram model over 64 classes of bytes.  Maximum-likelihood
estimates of orders 1 to 4 and the uniform one are mixed; the weights depend
on how often the longest context was seen (a bucket for each power of two) and
are learned by expectation-maximisation on the counts of held-out documents.
Counts cover all documents; the model's size is bounded by the classes and the
order (64^4 entries), however large the corpus is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, fold, pieces, text_views, tidy, unblob

CLASSES = 64
ORDER = 4
HELD_ONE_IN = 10
ROUNDS = 30
BUCKETS = 32

_CLASS = np.zeros(256, np.int32)  # 0: lead bytes and control
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 5
_CLASS[[ord(c) for c in ".!?"]] = 3
_CLASS[[ord(c) for c in ",;:"]] = 4
_CLASS[97:123] = np.arange(6, 32)
_CLASS[128:192] = 32 + (np.arange(64) >> 1)


def codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each byte; spaces stand before a text's start."""
    x = _CLASS[fold(buf)]
    out = x.copy()
    start = off[:-1][np.diff(off) > 0]
    end = off[1:][np.diff(off) > 0]
    for k in range(1, ORDER):
        y = np.ones(len(x), np.int32)
        y[k:] = x[:-k]
        for j in range(k):
            at = start + j
            y[at[at < end]] = 1
        out |= y << (6 * k)
    return out


def _count(batches):
    """Counts of a task's 4-grams, in documents that are held out and in others."""
    total = {False: np.zeros(CLASSES**ORDER, np.int32), True: np.zeros(CLASSES**ORDER, np.int32)}
    for batch in batches:
        buf, off, _ = text_views(batch.column("text"))
        held = np.asarray(batch.column("held"))
        for lo, hi in pieces(off):
            o = off[lo : hi + 1] - off[lo]
            c = codes(buf[off[lo] : off[hi]], o)
            out = np.repeat(held[lo:hi], np.diff(o))
            for side in (False, True):
                got, n = np.unique(c[out == side], return_counts=True)
                total[side][got] += n.astype(np.int32)
    at = np.flatnonzero(total[False] | total[True])
    if len(at):
        head = at >> 18
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])), [len(at)]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(head[cuts[:-1]].astype(np.int32)), blobs(at.astype(np.int32), cuts), blobs(total[False][at], cuts), blobs(total[True][at], cuts)],
            names=["head", "code", "kept", "held"],
        )


def _sum(t: pa.Table) -> pa.Table:
    code = unblob(t.column("code"), np.int32)[0] & ((1 << 18) - 1)
    kept = np.bincount(code, unblob(t.column("kept"), np.int32)[0], CLASSES**3).astype(np.int64)
    held = np.bincount(code, unblob(t.column("held"), np.int32)[0], CLASSES**3).astype(np.int64)
    at = np.flatnonzero(kept + held)
    one = np.array([0, len(at)])
    return pa.table({"head": t.column("head").slice(0, 1), "code": blobs(at.astype(np.int32), one), "kept": blobs(kept[at], one), "held": blobs(held[at], one)})


def _estimates(n4: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities [codes, 5], context counts) of codes ``at`` by counts n4."""
    n3 = n4.reshape(CLASSES, -1).sum(axis=0)
    n2 = n3.reshape(CLASSES, -1).sum(axis=0)
    n1 = n2.reshape(CLASSES, -1).sum(axis=0)
    p = np.zeros((len(at), ORDER + 1))
    for j, n in enumerate((n4, n3, n2, n1)):
        a = at & (len(n) - 1)
        context = n.reshape(-1, CLASSES).sum(axis=1)[a >> 6]
        p[:, j] = n[a] / np.maximum(context, 1)
        if j == 0:
            seen = context
    p[:, ORDER] = 1 / CLASSES
    return p, seen


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(seen + 1.0)).astype(np.int64), BUCKETS - 1)


def weights(kept: np.ndarray, held: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """[buckets, 5] mixture weights by expectation-maximisation on ``held``.

    A bucket without held-out events, and a corpus without any, keeps equal
    weights.
    """
    lam = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    at = np.flatnonzero(held)
    if not len(at):
        return lam
    p, seen = _estimates(kept, at)
    b, n = _bucket(seen), held[at].astype(float)
    for _ in range(rounds):
        share = lam[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, share[:, j], BUCKETS) for j in range(ORDER + 1)], axis=1)
        total = new.sum(axis=1, keepdims=True)
        lam = np.where(total > 0, new / np.maximum(total, 1e-300), lam)
    return np.maximum(lam, 1e-6) / np.maximum(lam, 1e-6).sum(axis=1, keepdims=True)


def log_table(n4: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """The natural logarithm of the mixed probability of every 4-gram."""
    out = np.empty(CLASSES**ORDER, np.float32)
    step = CLASSES**3
    for lo in range(0, len(out), step):
        at = np.arange(lo, lo + step)
        p, seen = _estimates(n4, at)
        out[lo : lo + step] = np.log((lam[_bucket(seen)] * p).sum(axis=1))
    return out


class Model:
    """Sparse counts and weights; each Python worker builds its table once."""

    def __init__(self, at: np.ndarray, n: np.ndarray, lam: np.ndarray):
        self.at, self.n, self.lam, self._table = at, n, lam, None

    def table(self) -> np.ndarray:
        if self._table is None:
            n4 = np.zeros(CLASSES**ORDER, np.int64)
            n4[self.at] = self.n
            self._table = log_table(n4, self.lam)
        return self._table


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = docs.select(F.col(text_col).alias("text"), (F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(HELD_ONE_IN)) == 0).alias("held")).where("text is not null")
    kind = "head int, code binary, kept binary, held binary"
    got = rows.mapInArrow(tidy(_count), kind).groupBy("head").applyInArrow(_sum, kind).toArrow()
    kept, held = np.zeros(CLASSES**ORDER, np.int64), np.zeros(CLASSES**ORDER, np.int64)
    for head, code, k, h in zip(*(got.column(c).to_pylist() for c in got.column_names)):
        at = (head << 18) + np.frombuffer(code, np.int32).astype(np.int64)
        kept[at], held[at] = np.frombuffer(k, np.int64), np.frombuffer(h, np.int64)
    lam = weights(kept, held)
    total = kept + held
    at = np.flatnonzero(total)
    return Model(at.astype(np.int32), total[at], lam)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """``(doc_id, n_bytes, log_prob, bits_per_byte)`` for every row of ``docs``.

    The model is learned from ``corpus`` (default ``docs``).  A null text has
    null scores; an empty one has n_bytes 0, log_prob 0 and null
    bits_per_byte.  A null id stays null, repeated rows are each scored and
    counted, an empty corpus gives the uniform model.  Other columns are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(corpus if corpus is not None else docs, id_col, text_col))

    def run(batches):
        table = model.value.table()
        for batch in batches:
            buf, off, null = text_views(batch.column("text"))
            total = np.zeros(batch.num_rows)
            for lo, hi in pieces(off):
                o = off[lo : hi + 1] - off[lo]
                lp = np.concatenate([[0.0], np.cumsum(table[codes(buf[off[lo] : off[hi]], o)], dtype=np.float64)])
                total[lo:hi] = lp[o[1:]] - lp[o[:-1]]
            n = np.diff(off)
            bits = -total / np.log(2) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, mask=null), pa.array(total, mask=null), pa.array(bits, mask=null | (n == 0))], names=["doc_id", "n_bytes", "log_prob", "bits_per_byte"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, log_prob double, bits_per_byte double")
