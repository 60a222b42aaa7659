"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

A text's features are its distinct words in lower case.  Its fingerprint has
``words`` words of ``word_bits`` bits; each bit is the majority, over the
features, of one bit of the feature's hash.  Two texts collide where one word
of their fingerprints differs in at most 2 bits: each fingerprint emits, for
each word, all variants within half that radius (1 bit), and variants meet in
the shuffle.  Colliding fingerprints are then compared in full.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blobs, buckets_for, documents, each_piece, mix, routed, stored, tidy, unblob
from .components import components

WORD_BITS = 36
WORDS = 14
MOST_DISTANCE = 0.17
TYPICAL = 0.12  # share of differing bits at which ``plan`` keeps the recall

_LANES = np.zeros(256, U64)
for _v in range(256):
    _LANES[_v] = sum(1 << (8 * _b) for _b in range(8) if _v >> _b & 1)
_KEY48 = U64((1 << 48) - 1)


def _planes(seed_hash: np.ndarray, n_bits: int) -> np.ndarray:
    """A feature hash's bits, as n_bits/8 rows of bytes."""
    rows = []
    for k in range((n_bits + 63) // 64):
        rows.append(mix(seed_hash + U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.uint8).reshape(-1, 8).T)
    return np.ascontiguousarray(np.vstack(rows)[: (n_bits + 7) // 8])


def fingerprints(col: pa.Array, n_bits: int) -> np.ndarray:
    """Rows of n_bits/8 bytes.  Texts without words all get the same random bits."""
    out = np.zeros((len(col), (n_bits + 7) // 8), np.uint8)
    for lo, hi, w in each_piece(col):
        key = np.sort((w.doc.astype(U64) << U64(48)) | (w.hash >> U64(16)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        doc = (key >> U64(48)).astype(np.int64)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        n = np.diff(first)
        if len(key):
            planes = _planes(key & _KEY48, n_bits)
            # blocks of at most 255 features of one text: byte lanes can't overflow
            per = (n + 254) // 255
            owner = np.repeat(np.arange(hi - lo), per)
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            start = first[:-1][owner] + 255 * inside
            heads = np.searchsorted(owner, np.flatnonzero(per > 0))
            have = np.flatnonzero(per > 0)
            for k in range(planes.shape[0]):
                lanes = np.add.reduceat(_LANES[planes[k]], start)
                count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
                bits = 2 * count > n[have][:, None]
                out[lo + have, k] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
        out[lo + np.flatnonzero(n == 0)] = _planes(np.array([0x243F6A8885A308D3], U64), n_bits).T
    spare = out.shape[1] * 8 - n_bits
    if spare:
        out[:, -1] &= 0xFF >> spare
    return out


def fingerprint_words(fp: np.ndarray, word_bits: int, words: int) -> np.ndarray:
    """[n, words] integers of word_bits bits."""
    bits = np.unpackbits(fp, axis=1, bitorder="little")[:, : word_bits * words].reshape(len(fp), words, word_bits)
    return (bits.astype(U64) << np.arange(word_bits, dtype=U64)).sum(axis=2, dtype=U64)


def variants(fp: np.ndarray, word_bits: int, words: int) -> np.ndarray:
    """[n, words*(word_bits+1)] keys: each word, and it with each one bit flipped."""
    flips = np.concatenate([[0], [1 << b for b in range(word_bits)]]).astype(U64)
    w = fingerprint_words(fp, word_bits, words) | (np.arange(words, dtype=U64) << U64(word_bits))
    return (w[:, :, None] ^ flips).reshape(len(fp), -1)


def recall(distance: float, word_bits: int, words: int) -> float:
    """How likely fingerprints that differ in this share of bits collide."""
    one = sum(comb(word_bits, k) * distance**k * (1 - distance) ** (word_bits - k) for k in range(3))
    return 1 - (1 - one) ** words


def plan(n: int) -> tuple[int, int]:
    """(word_bits, words) for ``n`` fingerprints.

    A key of b bits is met by chance by 37 n / 2^b others: words get longer
    from 2^28 fingerprints on, and more of them keep the recall.
    """
    bits, words = max(WORD_BITS, max(n - 1, 1).bit_length() + 8), WORDS
    while recall(TYPICAL, bits, words) < recall(TYPICAL, WORD_BITS, WORDS) - 1e-9:
        words += 1
    return bits, words


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _spread(batches, word_bits, words, buckets):
    """(id, fp) rows to one row per bucket: its keys and whose they are."""
    for batch in batches:
        ids = np.asarray(batch.column("id")).astype(np.int64)
        fps, _ = unblob(batch.column("fp"), np.uint8)
        fps = fps.reshape(len(ids), -1)
        for lo in range(0, len(ids), 4096):
            keys = variants(fps[lo : lo + 4096], word_bits, words)
            owner = np.repeat(ids[lo : lo + 4096], keys.shape[1])
            keys = keys.reshape(-1)
            bucket = (mix(keys) % U64(buckets)).astype(np.int64)
            order, which, cuts = routed(bucket, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), blobs(keys[order], cuts), blobs(owner[order], cuts)], names=["bucket", "keys", "ids"])


def _meet(table: pa.Table) -> pa.Table:
    """The keys of a bucket that several fingerprints have: (key, ids)."""
    keys, _ = unblob(table.column("keys"), U64)
    ids, _ = unblob(table.column("ids"), np.int64)
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    two = edge[size == 2]
    pair = np.sort(np.stack([ids[two], ids[two + 1]], axis=1), axis=1)
    pair = np.unique(pair, axis=0) if len(pair) else pair.reshape(0, 2)
    more = np.repeat(size > 2, size)
    return pa.table({
        "key": pa.array(np.concatenate([np.zeros(len(pair), np.int64), keys[more].view(np.int64)])),
        "a": pa.array(np.concatenate([pair[:, 0], ids[more]])),
        "b": pa.array(np.concatenate([pair[:, 1], np.zeros(more.sum(), np.int64)])),
        "two": pa.array(np.concatenate([np.ones(len(pair), bool), np.zeros(more.sum(), bool)])),
    })


def _grow(table: pa.Table, most: int) -> pa.Table:
    """Spanning edges of the near fingerprints among those that share a key.

    Breadth first: each one reached is compared with all not yet reached, so
    the components are those of the full comparison, and a dense group costs
    one comparison a member.
    """
    ids = np.asarray(table.column("a")).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    fps = unblob(table.column("fp"), np.uint8)[0].reshape(len(ids), -1)[order]
    left = np.arange(len(ids))
    edges = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = _distance(fps[at], fps[left]) <= most
            found, left = left[near], left[~near]
            edges.append(np.stack([np.full(len(found), ids[at]), ids[found]], axis=1))
            front = np.concatenate([front, found])
    e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(e[:, 0]), "b": pa.array(e[:, 1])})


def near_pairs(fps: DataFrame, word_bits: int, words: int, most: int) -> DataFrame:
    """``(id, fp)`` with distinct fp to edges whose components are the groups
    of fingerprints that collide and differ in at most ``most`` bits."""
    spark = fps.sparkSession
    buckets = buckets_for(spark, fps.count() * words * (word_bits + 1) * 16)
    sent = fps.mapInArrow(tidy(lambda it: _spread(it, word_bits, words, buckets)), "bucket int, keys binary, ids binary")
    met = stored(sent.groupBy("bucket").applyInArrow(_meet, "key long, a long, b long, two boolean"), "met")
    other = fps.select(F.col("id").alias("b"), F.col("fp").alias("fq"))
    own = fps.select(F.col("id").alias("a"), "fp")
    pairs = met.where("two").select("a", "b").distinct().join(own, "a").join(other, "b")

    def verify(batches):
        for x in batches:
            p = unblob(x.column("fp"), np.uint8)[0].reshape(x.num_rows, -1)
            q = unblob(x.column("fq"), np.uint8)[0].reshape(x.num_rows, -1)
            near = pa.array(_distance(p, q) <= most)
            yield pa.RecordBatch.from_arrays([x.column("a").filter(near), x.column("b").filter(near)], names=["a", "b"])

    twos = pairs.mapInArrow(tidy(verify), "a long, b long")
    groups = met.where("not two").select("key", "a").join(own, "a")
    many = groups.groupBy("key").applyInArrow(lambda t: _grow(t, most), "a long, b long")
    return twos.union(many)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    word_bits: int | None = None,
    words: int | None = None,
    most_distance: float = MOST_DISTANCE,
) -> DataFrame:
    """``(doc_id, keep_id)``: each document that goes, and the one that stays.

    The least id of a group stays.  Groups are the connected components of
    "fingerprints collide and differ in at most ``most_distance`` of their
    bits"; equal fingerprints are one group at once.  Fingerprints are of
    ``words`` words of ``word_bits`` bits, by default those of ``plan``: 14 of
    36 up to 2^28 rows.  Rows with a null id or
    text are in no group; texts without words equal each other.  A repeated id with
    several texts joins their groups.  Other columns are ignored, whatever
    their names.  An empty table gives an empty one.
    """
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    if word_bits is None or words is None:
        word_bits, words = plan(known.count())
    n_bits = word_bits * words
    most = int(most_distance * n_bits)

    def make(batches):
        for batch in batches:
            fp = fingerprints(batch.column("text"), n_bits)
            yield pa.RecordBatch.from_arrays([batch.column("id"), blobs(fp, np.arange(len(fp) + 1))], names=["id", "fp"])

    fps = stored(known.mapInArrow(tidy(make), "id long, fp binary"), "fps")
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp"), "reps")
    same = fps.join(reps.select("fp", F.col("id").alias("a")), "fp").where("a <> id").select("a", F.col("id").alias("b"))
    # a repeated id has several fingerprints: all of them are compared
    roots = components(same.union(near_pairs(reps, word_bits, words, most)))
    return roots.select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
