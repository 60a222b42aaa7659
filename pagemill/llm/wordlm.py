"""Language-model scoring with deleted interpolation over word n-grams.

Maximum-likelihood estimates of word trigrams, bigrams, single words and the
uniform one are mixed; the weights depend on how often the context was seen (a
bucket for each power of two) and are learned by expectation-maximisation on
held-out documents.  The counts are a table of n-gram hashes that is spread
over the cluster and grows with the corpus: chunks of documents send their
distinct n-grams with counts to the table's parts, the parts send back the
sums, and each chunk scores its texts from them.  The driver holds the weights
and four totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, blobs, documents, mix, pieces, release, routed, shuffle_partitions, stored, text_views, tidy

ORDER = 3
HELD_ONE_IN = 10
ROUNDS = 30
BUCKETS = 48
CHUNK_BYTES = 2 << 20
RANGE_KEYS = 1 << 19
KEPT, HELD, QUERY = 0, 1, 2

_START, _END = U64(0x452821E638D01377), U64(0xBE5466CF34E90C6C)
_STEP = U64(0xD6E8FEB86659FD93)
_SENT = U64(16)  # bits of a key that only choose its part of the table, which knows keys by the 48 others
_WORD = U64(1)  # the order of a single word
_CHUNK = "chunk long, role int, docs long, events long, ids binary, size binary, text binary"


# ---------------------------------------------------------------------- chunks


def _chunks(batches, side: int):
    """(id, text, role) rows to chunks of the texts of one role, with the
    numbers of texts that have bytes and of their events."""
    at = 0
    task = TaskContext.get().partitionId()
    for batch in batches:
        roles = np.asarray(batch.column("role"))
        for role in np.unique(roles).tolist():
            part = batch.filter(pa.array(roles == role))
            buf, off, null = text_views(part.column("text"))
            ids = part.column("id")
            for lo, hi in pieces(off, CHUNK_BYTES):
                data = buf[off[lo] : off[hi]]
                size = np.where(null[lo:hi], -1, np.diff(off[lo : hi + 1]))
                events, _ = _events(data, np.maximum(size, 0))
                some = ids.slice(lo, hi - lo)
                known = np.asarray(some.is_valid()).astype(np.int64)
                pair = np.stack([known, np.asarray(some.fill_null(0)).astype(np.int64)])
                one = np.array([0, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([((task << 32) | at) * 2 + side]), pa.array([role], pa.int32()), pa.array([int((size > 0).sum())]), pa.array([len(events)]),
                     blobs(pair.reshape(1, -1), one), blobs(size.astype(np.int64).reshape(1, -1), one), pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)], pa.binary())],
                    names=["chunk", "role", "docs", "events", "ids", "size", "text"],
                )
                at += 1


def _events(buf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with each text's end after its last, first event of each text).
    A text without bytes has no event, one without words has its end."""
    off = np.concatenate([[0], np.cumsum(size)])
    got, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lo, hi in pieces(off):
        w = Words(buf[off[lo] : off[hi]], off[lo : hi + 1])
        many = np.diff(w.first) + (size[lo:hi] > 0)
        first = np.cumsum(many) - many
        x = np.full(many.sum(), _END, U64)
        x[np.arange(len(w.hash)) + (first - w.first[:-1])[w.doc]] = w.hash
        got.append(x)
        n.append(many)
    return np.concatenate(got), np.concatenate([[0], np.cumsum(np.concatenate(n))])


def _grams(buf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([3, events] keys of the tri-, bi- and unigram that end at each event,
    first event of each text).  A key's first 2 bits are its order."""
    x, first = _events(buf, size)
    start = first[:-1][np.diff(first) > 0]
    b, c = np.full(len(x), _START, U64), np.full(len(x), _START, U64)
    b[1:], c[2:] = x[:-1], x[:-2]
    b[start] = c[start] = _START
    second = start + 1
    c[second[second < len(x)]] = _START
    one = mix(x + _STEP)
    two = mix(b * _STEP + x)
    three = mix((c * _STEP + b) * _STEP + x)
    return np.stack([h >> U64(2) | U64(k << 62) for k, h in ((3, three), (2, two), (1, one))]), first


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    size = np.frombuffer(row["size"], np.int64)
    n = int(np.maximum(size, 0).sum())
    return np.frombuffer(pa.decompress(row["text"], n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8), size


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys & U64((1 << 16) - 1)) % U64(buckets)).astype(np.int64)


# --------------------------------------------------------------- count table


def _planes(x: np.ndarray) -> bytes:
    """Integers as planes of their bytes, compressed, after their number."""
    data = x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.int64(len(x)).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unplanes(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    flat = pa.decompress(data[8:], 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]


def _send(batches, buckets: int):
    """A chunk's distinct n-grams and their counts, to the table's parts."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            buf, size = _read(row)
            keys, _ = _grams(buf, np.maximum(size, 0))
            keys, n = np.unique(keys, return_counts=True)
            order, which, cuts = routed(_bucket_of(keys, buckets), buckets)
            keys, n = (keys[order] >> _SENT).view(np.int64), n[order]
            ends = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            m = len(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(which.astype(np.int32)), pa.array(np.full(m, row["chunk"])), pa.array(np.full(m, row["role"], np.int32)),
                 pa.array([_planes(np.diff(keys[a:b], prepend=0)) for a, b in ends], pa.binary()), pa.array([_planes(n[a:b]) for a, b in ends], pa.binary())],
                names=["bucket", "chunk", "role", "keys", "n"],
            )


def _sum(t: pa.Table) -> pa.Table:
    """One part of the table: to each chunk the sums of its n-grams over all
    counted documents and, for a held-out chunk, over those not held out; and
    (as chunk -1) the number of distinct words."""
    roles = np.asarray(t.column("role"))
    keys = [np.cumsum(_unplanes(b.as_py())) for b in t.column("keys")]
    n = [_unplanes(b.as_py()).astype(np.int32) for b in t.column("n")]
    total, kept = [np.empty(len(k), np.int64) for k in keys], [np.empty(len(k) * (r == HELD), np.int64) for k, r in zip(keys, roles)]
    words = 0
    # each chunk's keys are sorted: ranges of them are summed one by one
    some = np.sort(np.concatenate([k[::256] for k in keys]))
    marks = np.unique(some[:: max(1, RANGE_KEYS // 256)][1:])
    cuts = [np.concatenate([[0], np.searchsorted(k, marks), [len(k)]]) for k in keys]
    for at in range(len(marks) + 1):
        spans = [slice(c[at], c[at + 1]) for c in cuts]
        size = [s.stop - s.start for s in spans]
        own, place = np.unique(np.concatenate([k[s] for k, s in zip(keys, spans)]), return_inverse=True)
        m, role = np.concatenate([x[s] for x, s in zip(n, spans)]).astype(float), np.repeat(roles, size)
        of_kept = np.bincount(place, m * (role == KEPT), len(own)).astype(np.int64)
        of_all = np.bincount(place, m * (role != QUERY), len(own)).astype(np.int64)
        words += int(((own.view(U64) >> U64(46) == _WORD) & (of_all > 0)).sum())
        for k, (s, p) in enumerate(zip(spans, np.split(place, np.cumsum(size)[:-1]))):
            total[k][s] = of_all[p]
            if roles[k] == HELD:
                kept[k][s] = of_kept[p]
    del keys, n
    release()
    bucket = int(t.column("bucket")[0].as_py())
    return pa.table({
        "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int64()),
        "bucket": pa.array([bucket] * (len(total) + 1), pa.int32()),
        "total": pa.array([*map(_planes, total), None], pa.binary()),
        "kept": pa.array([*(_planes(x) if r == HELD else None for x, r in zip(kept, roles)), None], pa.binary()),
        "words": pa.array([0] * len(total) + [words], pa.int64()),
    })


def _counts(row: dict, parts: list[tuple[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """([3, events] counts of each event's n-grams, first event of each text)."""
    buf, size = _read(row)
    keys, first = _grams(buf, np.maximum(size, 0))
    own, at = np.unique(keys, return_inverse=True)
    order, _, _ = routed(_bucket_of(own, buckets), buckets)
    n = np.zeros(len(own), np.int64)
    if len(own):
        n[order] = np.concatenate([_unplanes(b) for _, b in sorted(parts)])
    return n[at.reshape(keys.shape)], first


# ----------------------------------------------------------------- estimates


def estimates(n: np.ndarray, first: np.ndarray, docs: int, events: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities [events, 4], context counts) from the counts of n-grams.

    A context is followed by an event wherever it occurs, so a bigram's count
    is that of the trigrams after it; a text's start was seen once a text.
    The uniform estimate is over the known words and one unknown.
    """
    after_two, after_one = np.empty_like(n[0]), np.empty_like(n[0])
    after_two[1:], after_one[1:] = n[1][:-1], n[2][:-1]
    start = first[:-1][np.diff(first) > 0]
    after_two[start] = after_one[start] = docs
    p = np.stack([n[0] / np.maximum(after_two, 1), n[1] / np.maximum(after_one, 1), n[2] / max(events, 1), np.full(n.shape[1], 1 / (words + 1))], axis=1)
    return p, after_two


def _level(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(seen + 1.0)).astype(np.int64), BUCKETS - 1)


def shares(lam: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """One round's expectation: (each estimate's share of the events of each
    bucket, their log-likelihood)."""
    share = lam[b] * p
    mixed = share.sum(axis=1, keepdims=True)
    return np.stack([np.bincount(b, c, BUCKETS) for c in (share / mixed).T], axis=1), float(np.log(mixed).sum())


def weights(held: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """[buckets, 4] weights by expectation-maximisation; every round is a pass
    over the held-out events.  A bucket without any keeps equal weights."""
    lam = np.full((BUCKETS, ORDER + 1), 1 / (ORDER + 1))
    before = -np.inf
    for _ in range(rounds):

        def expect(batches, lam=lam):
            total, fit = np.zeros((BUCKETS, ORDER + 1)), 0.0
            for batch in batches:
                for b, p in zip(batch.column("b").to_pylist(), batch.column("p").to_pylist()):
                    s, f = shares(lam, np.frombuffer(b, np.uint8).astype(np.int64), np.frombuffer(p, np.float32).reshape(-1, ORDER + 1).astype(float))
                    total, fit = total + s, fit + f
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([fit])], names=["total", "fit"])

        got = held.mapInArrow(tidy(expect), "total binary, fit double").collect()
        total = sum((np.frombuffer(r.total).reshape(lam.shape) for r in got), np.zeros(lam.shape))
        count = total.sum(axis=1, keepdims=True)
        if not count.sum():
            break
        lam = np.where(count > 0, total / np.maximum(count, 1e-300), lam)
        fit = sum(r.fit for r in got) / count.sum()
        if fit - before < 1e-5:
            break
        before = fit
    lam = np.maximum(lam, 1e-6)
    return lam / lam.sum(axis=1, keepdims=True)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_bytes, log_prob, bits_per_byte)`` for every row of ``docs``.

    ``log_prob`` is the natural logarithm of the probability of the text's
    words in lower case and of its end.  The model is learned from ``corpus``
    (default ``docs``).  A null text has null scores; an empty one has n_bytes
    0, log_prob 0 and null bits_per_byte; one without words has its end only.
    A null id stays null, repeated rows are each scored and counted, an empty
    corpus gives the uniform model.  Other columns are ignored.
    """
    buckets = 2 * shuffle_partitions(docs.sparkSession)  # a part of the table is held whole by one worker
    number, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    held = F.when(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(HELD_ONE_IN)) == 0, F.lit(HELD)).otherwise(F.lit(KEPT))
    learned = (docs if corpus is None else corpus).select(number, text, held.alias("role"))
    made = learned.mapInArrow(tidy(lambda it: _chunks(it, 0)), _CHUNK)
    if corpus is not None:
        made = made.union(docs.select(number, text, F.lit(QUERY).alias("role")).mapInArrow(tidy(lambda it: _chunks(it, 1)), _CHUNK))
    chunks = stored(made, "lm-chunks")
    sizes = {r.role: (r.docs, r.events) for r in chunks.groupBy("role").agg(F.sum("docs").alias("docs"), F.sum("events").alias("events")).collect()}
    kept_docs, kept_events = sizes.get(KEPT, (0, 0))
    all_docs, all_events = (sum(sizes.get(r, (0, 0))[k] for r in (KEPT, HELD)) for k in (0, 1))

    sent = chunks.mapInArrow(tidy(lambda it: _send(it, buckets)), "bucket int, chunk long, role int, keys binary, n binary")
    sums = stored(sent.groupBy("bucket").applyInArrow(_sum, "chunk long, bucket int, total binary, kept binary, words long"), "lm-sums")
    words = sums.where("chunk = -1").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    def with_sums(rows: DataFrame, which: str) -> DataFrame:
        parts = sums.where("chunk >= 0").select("chunk", "bucket", F.col(which).alias("n")).where("n is not null")
        nothing = F.lit(None)
        left = rows.select("chunk", "ids", "size", "text", nothing.cast("int").alias("bucket"), nothing.cast("binary").alias("n"))
        return left.unionByName(parts.select("chunk", nothing.cast("binary").alias("ids"), nothing.cast("binary").alias("size"), nothing.cast("binary").alias("text"), "bucket", "n"))

    def of_chunk(t: pa.Table) -> tuple[dict | None, np.ndarray | None, np.ndarray | None]:
        rows = t.to_pylist()
        own = [r for r in rows if r["size"] is not None]
        if not own:
            return None, None, None
        n, first = _counts(own[0], [(r["bucket"], r["n"]) for r in rows if r["size"] is None], buckets)
        release()
        return own[0], n, first

    def held_events(t: pa.Table) -> pa.Table:
        _, n, first = of_chunk(t)
        if n is None:
            return pa.table({"b": pa.array([], pa.binary()), "p": pa.array([], pa.binary())})
        p, seen = estimates(n, first, kept_docs, kept_events, words)
        return pa.table({"b": pa.array([_level(seen).astype(np.uint8).tobytes()], pa.binary()), "p": pa.array([p.astype(np.float32).tobytes()], pa.binary())})

    held_rows = with_sums(chunks.where(f"role = {HELD}"), "kept").groupBy("chunk").applyInArrow(held_events, "b binary, p binary")
    lam = weights(stored(held_rows, "lm-held"))

    def scores(t: pa.Table) -> pa.Table:
        row, n, first = of_chunk(t)
        if row is None:
            return _result(np.zeros((2, 0), np.int64), np.zeros(0, np.int64), np.zeros(0))
        p, seen = estimates(n, first, all_docs, all_events, words)
        at = np.concatenate([[0.0], np.cumsum(np.log((lam[_level(seen)] * p).sum(axis=1)))])
        return _result(np.frombuffer(row["ids"], np.int64).reshape(2, -1), np.frombuffer(row["size"], np.int64), at[first[1:]] - at[first[:-1]])

    asked = chunks if corpus is None else chunks.where(f"role = {QUERY}")
    return with_sums(asked, "total").groupBy("chunk").applyInArrow(scores, "doc_id long, n_bytes long, log_prob double, bits_per_byte double")


def _result(ids: np.ndarray, size: np.ndarray, total: np.ndarray) -> pa.Table:
    null = size < 0
    bits = -total / np.log(2) / np.maximum(size, 1)
    return pa.table({"doc_id": pa.array(ids[1], mask=ids[0] == 0), "n_bytes": pa.array(size, mask=null), "log_prob": pa.array(total, mask=null), "bits_per_byte": pa.array(bits, mask=null | (size == 0))})


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op8_deleted_interpolation": op8_deleted_interpolation}
