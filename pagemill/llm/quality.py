"""Quality and toxicity by supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document's vector
is their average, and a softmax over it gives the classes.  Vectors and output
weights are trained here by stochastic gradient descent in numpy, each step
normalised by the document's own length.  As the average and the output are
linear, a trained model scores a document by adding one number a feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, documents, mix, pieces, text_views, tidy

BITS = 20
LEAST_SEEN = 8
SEEN_ONE_IN = 100
DIMS = 4
EPOCHS = 10
RATE = 1.0
SAMPLE = 8000
SAMPLE_BYTES = 64 << 20
GRAMS = (5,)
LEAST_QUALITY = 0.5
MOST_TOXIC = 0.5


def feature_ids(w: Words, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first feature of each text): its words, and its runs of
    5 lower-case bytes, white space and signs included."""
    n = len(w.low)
    words = (mix(w.hash + U64(77)) >> U64(64 - BITS)).astype(np.int32)
    last = np.repeat(off[1:], np.diff(off))
    x = w.low.astype(np.uint64)
    ids, owner = [words], [w.doc]
    for size in GRAMS:
        at = np.flatnonzero(np.arange(n) + size <= last)
        g = np.zeros(max(0, n - size + 1), U64)
        for j in range(size):
            g = (g << U64(8)) | x[j : j + len(g)]
        ids.append(((g[at] * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int32))
        owner.append(np.searchsorted(off, at, "right") - 1)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(off)))


class Head:
    """One softmax over averaged vectors."""

    def __init__(self, classes: int = 2, seed: int = 1):
        r = np.random.default_rng(seed)
        self.e = r.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS))
        self.w = r.uniform(-1, 1, (classes, DIMS))
        self.b = np.zeros(classes)

    def train(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> Head:
        """``docs`` are (distinct features, their shares of the text)."""
        r = np.random.default_rng(3)
        weight = len(y) / (len(self.b) * np.maximum(np.bincount(y, minlength=len(self.b)), 1)) ** 1.0
        weight = np.sqrt(weight)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in r.permutation(len(docs)):
                f, share = docs[i]
                if not len(f):
                    continue
                v = share @ self.e[f]
                z = self.w @ v + self.b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                p *= weight[y[i]]
                back = self.w.T @ p
                # a step moves a document's own scores alike, long or short
                self.e[f] -= (step * share / (share @ share))[:, None] * back
                self.w -= step * np.outer(p, v) / (1 + v @ v)
                self.b -= 0.1 * step * p
        return self

    def margins(self) -> tuple[np.ndarray, float]:
        """Of two classes: what each feature adds for class 1, and the offset."""
        return (self.e @ (self.w[1] - self.w[0])).astype(np.float32), float(self.b[1] - self.b[0])


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        off = np.array([0, len(data)])
        ids, _ = feature_ids(Words(data, off), off)
        f, n = np.unique(ids, return_counts=True)
        out.append((f, n.astype(np.float32)))
    return out


def _share(f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return f, n / max(np.float32(1), n.sum())


class Model:
    def __init__(self, rows: list[tuple[str, int | None, int | None]]):
        """rows: (text, quality, toxic), labels 0, 1 or None."""
        bags = _bags([r[0] for r in rows])
        seen = np.zeros(1 << BITS, np.int32)
        for f, _ in bags:
            seen[f] += 1
        # rarer features would learn single documents by heart
        self.known = seen >= max(1, min(LEAST_SEEN, len(bags) // SEEN_ONE_IN))
        for i, (f, n) in enumerate(bags):  # in place: the sample is held once
            bags[i] = _share(f[self.known[f]], n[self.known[f]])
        self.heads = []
        for k in (1, 2):
            at = [i for i, r in enumerate(rows) if r[k] in (0, 1)]
            y = np.array([rows[i][k] for i in at], np.int64)
            if len(set(y.tolist())) < 2:  # one class or none: always that one
                self.heads.append((np.zeros(1 << BITS, np.float32), 20.0 if (y.all() if len(y) else k == 1) else -20.0))
            else:
                margin, base = Head(seed=k).train([bags[i] for i in at], y).margins()
                self.heads.append((np.where(self.known, margin, np.float32(0)), base))

    def probabilities(self, col: pa.Array) -> np.ndarray:
        """[texts, 2]: of quality and of toxicity."""
        buf, off, _ = text_views(col)
        out = np.zeros((len(off) - 1, 2))
        for lo, hi in pieces(off):
            o = off[lo : hi + 1] - off[lo]
            ids, first = feature_ids(Words(buf[off[lo] : off[hi]], o), o)
            n = np.diff(np.concatenate([[0], np.cumsum(self.known[ids])])[first])
            for k, (margin, base) in enumerate(self.heads):
                s = np.concatenate([[0.0], np.cumsum(margin[ids], dtype=np.float64)])
                out[lo:hi, k] = (s[first[1:]] - s[first[:-1]]) / np.maximum(n, 1) + base
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of at most ``sample`` labelled documents, those of least hashed
    id, and of those as many as have ``sample_bytes`` of text together (a first
    one that is longer is taken alone).  An id with several texts teaches its
    least one; rows with a null id or text teach nothing."""
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("id is not null")
    chosen = lab.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "q", "t").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    # the sample is bounded by ``sample`` rows of 24 bytes: safe to broadcast
    got = texts.join(F.broadcast(chosen), "id").groupBy("h", "id", "q", "t").agg(F.min("text").alias("text"))
    order = Window.orderBy("h", "id", F.col("q").asc_nulls_first(), F.col("t").asc_nulls_first())
    got = got.withColumn("before", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = got.where(F.coalesce("before", F.lit(0)) + F.when(F.col("before").isNull(), 0).otherwise(F.octet_length("text")) <= sample_bytes).collect()
    rows.sort(key=lambda r: (r["h"], r["id"], r["text"], str(r["q"]), str(r["t"])))
    return Model([(r["text"], r["q"], r["t"]) for r in rows])


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_quality: float = LEAST_QUALITY,
    most_toxic: float = MOST_TOXIC,
    sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """``(doc_id, quality, toxic, keep)`` for every row of ``docs``.

    ``quality`` and ``toxic`` are probabilities; ``keep`` is quality of at
    least ``least_quality`` and toxic under ``most_toxic``.  ``labels`` has
    doc_id, quality and toxic, 0 or 1 or null; the model learns from a sample
    of at most ``sample`` rows and ``sample_bytes`` of text, and knows the
    features that 8 of its documents have, or one in a hundred where these are
    fewer, but one at least.  A null text has null results; an empty one is
    scored by the offsets alone; a null id stays null; repeated rows are each
    scored.  Without labels quality is 1 and toxic 0.  Other columns are
    ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample, sample_bytes))

    def run(batches):
        for batch in batches:
            col = batch.column("text")
            p, null = model.value.probabilities(col), np.asarray(col.is_null())
            keep = (p[:, 0] >= least_quality) & (p[:, 1] < most_toxic)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, mask=null) for x in (p[:, 0], p[:, 1], keep))], names=["doc_id", "quality", "toxic", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, quality double, toxic double, keep boolean")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their scores."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep")


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
