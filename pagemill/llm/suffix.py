"""Repeated passages, by suffix sorting in range-partitioned buckets.

Every window of ``length`` words is a truncated suffix, and a passage repeats
where two suffixes of different documents share their first ``length`` words.

1.  Each suffix is filed under its anchor: the word 8-gram of least hash (the
    last of equals) among those in its first ``length`` words.  Equal windows
    have equal anchors, so anchors that occur in one document only rule their
    suffixes out.  Anchors are about one word in 22.
2.  The text around anchors of several documents (all suffixes filed under
    them, as word hashes) is shuffled by range of the anchor's leading words;
    the ranges come from splitters sampled over all such anchors.  Leading
    words so frequent that several splitters fall on them get as many buckets,
    by document.
3.  Each bucket sorts its suffixes by multikey quicksort, 8 words a key, and
    neighbours that agree in all of ``length`` words are repeats.  Splitters
    between different leading words part no equal suffixes; buckets of the same
    leading words are compared across their boundaries: each sends its distinct
    suffixes, with the least and greatest document that has them, and gets back
    those of all.
4.  Overlapping repeated windows of a document make one passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blobs, buckets_for, documents, each_piece, mix, plan_bytes, routed, stored, tidy, unblob, window_hash, windows_inside

LENGTH = 50
GRAM = 8
SAMPLED = 64  # anchors a bucket, of which the splitters are quantiles
MOST_SAMPLED = 1 << 22  # in all: they only balance the buckets
_LOW = U64((1 << 28) - 1)


def anchors(hash_: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix starts, anchor of each, 8-gram hashes): suffixes of ``length``
    words within one text, and the word at which their anchor starts."""
    starts = windows_inside(first, length)
    g = window_hash(hash_, gram)
    if not len(starts):
        return starts, starts, g
    n = len(g)
    # least hash, then the last place: hash above, inverted place below
    key = (g & ~_LOW) | (_LOW - np.arange(n, dtype=U64))
    span, width, least = length - gram + 1, 1, key
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    at = np.minimum(least[starts], least[starts + span - width])
    return starts, (_LOW - (at & _LOW)).astype(np.int64), g


def _leading(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A sortable 62-bit key of the two leading words."""
    return ((h[at] >> U64(33)) << U64(31) | (h[at + 1] >> U64(33))).astype(np.int64)


def _file(batches, length, gram, buckets):
    """One row a bucket: anchors' 8-gram hashes, documents and places."""
    for batch in batches:
        ids = np.asarray(batch.column("id"))
        found = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for lo, _, w in each_piece(batch.column("text")):
            _, at, g = anchors(w.hash, w.first, length, gram)
            at = np.unique(at)
            doc = w.doc[at]
            found.append((g[at], ids[lo + doc], (at - w.first[:-1][doc]).astype(np.int32), _leading(w.hash, at)))
        g, doc, place, lead = (np.concatenate(x) for x in zip(*found))
        if not len(g):
            continue
        order, which, cuts = routed((g % U64(buckets)).astype(np.int64), buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), blobs(g[order], cuts), blobs(doc[order], cuts), blobs(place[order], cuts), blobs(lead[order], cuts)], names=["bucket", "gram", "doc", "place", "lead"]
        )


def _shared(t: pa.Table) -> pa.Table:
    """The anchors of a bucket that several documents have."""
    gram, doc = unblob(t.column("gram"), U64)[0], unblob(t.column("doc"), np.int64)[0]
    place, lead = unblob(t.column("place"), np.int32)[0], unblob(t.column("lead"), np.int64)[0]
    order = np.argsort(gram, kind="stable")
    gram, doc, place, lead = gram[order], doc[order], place[order], lead[order]
    edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    if len(edge):
        differ = np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)
        keep = np.repeat(differ, np.diff(np.concatenate([edge, [len(gram)]])))
        doc, place, lead = doc[keep], place[keep], lead[keep]
    return pa.table({"id": pa.array(doc), "place": pa.array(place), "lead": pa.array(lead)})


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, is a row equal to the one before it in that order).

    Multikey quicksort on the columns of ``keys``: rows are parted by the
    first column, and only parts of several rows go on to the next.
    """
    n, depth = keys.shape
    order = np.arange(n)
    group = np.zeros(n, np.int64)  # the part of each place, by its first place
    open_ = np.ones(n, bool)
    for j in range(depth):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        k = keys[order[at], j]
        new = np.lexsort((k, group[at]))
        order[at] = order[at[new]]
        k, g = k[new], group[at]
        head = np.ones(len(at), bool)
        head[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        group[at] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        alone = head & np.concatenate([head[1:], [True]])
        open_[at[alone]] = False
    same = np.zeros(n, bool)
    same[1:] = open_[1:] & open_[:-1] & (group[1:] == group[:-1])
    return order, same


class Splits:
    """Buckets of anchors by their leading words."""

    def __init__(self, sample: np.ndarray, buckets: int):
        """``sample``: leading words of some anchors, sorted."""
        at = sample[np.linspace(0, len(sample), buckets + 1).astype(np.int64)[1:-1]] if len(sample) else sample
        self.cuts, times = np.unique(at, return_counts=True)
        self.parts = np.where(times > 1, times, 0)
        self.first = len(self.cuts) + 1  # from here on, buckets of one hot key
        self.begin = self.first + np.cumsum(self.parts) - self.parts

    def bucket(self, lead: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.cuts, lead, "right")
        at = out - 1  # the cut that the key may equal
        hot = np.flatnonzero((at >= 0) & (self.cuts[np.maximum(at, 0)] == lead) & (self.parts[np.maximum(at, 0)] > 0)) if len(self.cuts) else at[:0]
        k = at[hot]
        out[hot] = self.begin[k] + (mix(doc[hot].astype(U64)) % self.parts[k].astype(U64)).astype(np.int64)
        return out

    def __len__(self) -> int:
        return int(self.first + self.parts.sum())

    def split(self) -> bool:
        return bool(self.parts.any())


def _contexts(batches, length, gram, splits):
    """The text around shared anchors, one row a bucket of leading words."""
    for batch in batches:
        ids = np.asarray(batch.column("id"))
        lists = batch.column("places")
        flat, n = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
        begin = np.concatenate([[0], np.cumsum(n)])
        for lo, hi, w in each_piece(batch.column("text")):
            start, at, _ = anchors(w.hash, w.first, length, gram)
            if not len(start):
                continue
            want = np.zeros(len(w.hash) + 1, bool)
            mine = flat[begin[lo] : begin[hi]] + np.repeat(w.first[:-1], n[lo:hi])
            inside = mine < np.repeat(w.first[1:], n[lo:hi])
            want[mine[inside]] = True
            keep = want[at]
            start, at = start[keep], at[keep]
            if not len(start):
                continue
            # suffixes of one anchor follow each other: one stretch of text
            head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
            count = np.diff(np.concatenate([head, [len(start)]]))
            words = count + length - 1
            at, start = at[head], start[head]
            order, which, edge = routed(splits.bucket(_leading(w.hash, at), ids[lo + w.doc[start]]), len(splits))
            start, count, words = start[order], count[order], words[order]
            doc = w.doc[start]
            off = np.concatenate([[0], np.cumsum(words)])
            take = np.repeat(start - off[:-1], words) + np.arange(off[-1])
            head_row = np.stack([ids[lo + doc], start - w.first[:-1][doc], count], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), blobs(w.hash[take], off[edge]), blobs(head_row, edge)], names=["bucket", "text", "head"])


def _sorted(t: pa.Table, length: int):
    """A bucket's suffixes in order: (document, first word, first place of each
    run of equal ones, a hash of each run's words)."""
    text = unblob(t.column("text"), U64)[0]
    head, _ = unblob(t.column("head"), np.int64, 3)
    if not len(head):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    count = head[:, 2]
    off = np.concatenate([[0], np.cumsum(count + length - 1)])[:-1]
    row = np.repeat(np.arange(len(head)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row] + nth
    # 8 words a key; the last key overlaps the one before it to end at ``length``
    step = min(8, length)
    block = window_hash(text, step)
    places = [*range(0, length - step + 1, step)]
    if places[-1] != length - step:
        places.append(length - step)
    keys = np.stack([text[at]] + [block[at + p] for p in places], axis=1)
    order, same = multikey_sort(keys)
    edge = np.flatnonzero(~same)
    sign = np.zeros(len(edge), U64)
    for column in keys[order[edge]].T:
        sign = mix(sign * U64(0xD6E8FEB86659FD93) + column)
    return head[row, 0][order], (head[row, 1] + nth)[order], edge, sign


def _reach(doc: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(edge):
        return doc[:0], doc[:0]
    return np.minimum.reduceat(doc, edge), np.maximum.reduceat(doc, edge)


def _ends(t: pa.Table, length: int, first: int) -> pa.Table:
    """The distinct suffixes of a bucket of one hot key, with the least and the
    greatest document that has each."""
    bucket = t.column("bucket")[0].as_py()
    doc, _, edge, sign = _sorted(t if bucket >= first else t.slice(0, 0), length)
    low, high = _reach(doc, edge)
    return pa.table({"bucket": pa.array(np.full(len(edge), bucket, np.int32)), "sign": pa.array(sign.view(np.int64)), "low": pa.array(low), "high": pa.array(high)})


def _repeats(t: pa.Table, across: pa.Table | None, length: int) -> pa.Table:
    """A bucket's repeated suffixes: (doc, first word, stretch of them, first doc)."""
    doc, start, edge, sign = _sorted(t, length)
    if not len(edge):
        return pa.table({c: pa.array([], pa.int64()) for c in ("id", "start", "stop", "first")})
    low, high = _reach(doc, edge)
    if across is not None and across.num_rows:
        theirs = np.asarray(across.column("sign")).astype(np.int64).view(U64)
        order = np.argsort(theirs)
        at = order[np.minimum(np.searchsorted(theirs[order], sign), len(order) - 1)]
        met = theirs[at] == sign
        low = np.where(met, np.asarray(across.column("low"))[at], low)
        high = np.where(met, np.asarray(across.column("high"))[at], high)
    size = np.diff(np.concatenate([edge, [len(doc)]]))
    keep = np.repeat(low != high, size)
    doc, start, first = doc[keep], start[keep], np.repeat(low, size)[keep]
    order = np.lexsort((start, doc))
    doc, start, first = doc[order], start[order], first[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    heads = np.flatnonzero(new)
    ends = np.concatenate([heads[1:], [len(doc)]]).astype(np.int64) - 1
    least = np.minimum.reduceat(first, heads) if len(heads) else first
    return pa.table({"id": pa.array(doc[heads]), "start": pa.array(start[heads]), "stop": pa.array(start[ends] + length if len(heads) else start), "first": pa.array(least)})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, stop, first_doc_id)``: passages that other documents have too.

    ``start`` and ``stop`` are word numbers (words as lower-case runs of
    letters and digits); each passage is a longest stretch of which every
    ``length`` words occur in another document, ``first_doc_id`` the least id
    among the documents that have one of them: where it is ``doc_id``, this
    is the first copy.  Rows with a null id or text, and texts under
    ``length`` words, have none.  Rows that share an id are one document,
    each with its own words.  An empty table gives an empty one; other
    columns are ignored.
    """
    if not gram <= length:
        raise ValueError("length must be at least the anchor's words")
    spark = docs.sparkSession
    buckets = buckets_for(spark, 4 * plan_bytes(docs))  # word hashes take more room than Parquet text
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    filed = rows.mapInArrow(tidy(lambda it: _file(it, length, gram, buckets)), "bucket int, gram binary, doc binary, place binary, lead binary")
    shared = stored(filed.groupBy("bucket").applyInArrow(_shared, "id long, place int, lead long"), "anchors")
    # splitters: quantiles of the leading words of a sample of the shared anchors
    n = shared.count()
    some = shared.select("lead").sample(fraction=min(1.0, min(SAMPLED * buckets, MOST_SAMPLED) / max(n, 1)), seed=7).toArrow().column("lead")
    splits = Splits(np.sort(np.asarray(some).astype(np.int64)), buckets)
    places = shared.groupBy("id").agg(F.collect_set("place").alias("places"))
    around = rows.join(places, "id").select("id", "text", "places").mapInArrow(tidy(lambda it: _contexts(it, length, gram, splits)), "bucket int, text binary, head binary").groupBy("bucket")
    found_type = "id long, start long, stop long, first long"
    if splits.split():
        # the text around anchors is shuffled once and read twice
        ends = around.applyInArrow(lambda t: _ends(t, length, splits.first), "bucket int, sign long, low long, high long")
        of_all = ends.groupBy("sign").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("bucket").alias("in")).where("size(in) > 1 and low <> high")
        across = of_all.select(F.explode("in").alias("bucket"), "sign", "low", "high")
        found = around.cogroup(across.groupBy("bucket")).applyInArrow(lambda t, x: _repeats(t, x, length), found_type)
    else:
        found = around.applyInArrow(lambda t: _repeats(t, None, length), found_type)
    return _joined(found).select(F.col("id").alias("doc_id"), "start", "stop", F.col("first").alias("first_doc_id"))


def _joined(found: DataFrame) -> DataFrame:
    """Stretches whose windows follow each other or overlap, as one."""

    def join(batches):
        for batch in batches:
            s, e, f = (batch.column(c) for c in ("starts", "stops", "firsts"))
            n = np.asarray(s.value_lengths())
            doc = np.repeat(np.arange(len(n)), n)
            s, e, f = (np.asarray(c.flatten()) for c in (s, e, f))
            order = np.lexsort((s, doc))
            doc, s, e, f = doc[order], s[order], e[order], f[order]
            reach = np.maximum.accumulate(e + doc * (1 << 40)) - doc * (1 << 40) if len(e) else e
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])
            heads = np.flatnonzero(new)
            last = np.concatenate([heads[1:], [len(doc)]]).astype(np.int64) - 1
            ids = np.asarray(batch.column("id"))[doc[heads]]
            low = np.minimum.reduceat(f, heads) if len(heads) else f
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, s[heads], reach[last] if len(heads) else e, low)], names=["id", "start", "stop", "first"])

    lists = found.groupBy("id").agg(*(F.collect_list(F.struct("start", "stop", "first")).alias("x"),)).select("id", *(F.col(f"x.{c}").alias(f"{c}s") for c in ("start", "stop", "first")))
    return lists.mapInArrow(tidy(join), "id long, start long, stop long, first long")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
