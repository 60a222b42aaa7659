"""Token ids as canonical length-limited Huffman codes.

Lengths come from the global counts of all ids (package-merge, at most
``LIMIT`` bits).  A document's codes are one bit string with a checkpoint, its
bit offset, every ``BLOCK`` ids; blocks decode independently of each other, by
a table indexed with the next ``LIMIT`` bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoding, token_bytes
from .common import U64, blobs, documents, pieces, span_hash, stored, text_views, tidy

LIMIT = 18
BLOCK = 128
SLICE = 2 << 20  # bytes of packed ids that are coded together
GROUP = 8 << 20  # bytes of texts whose equal words are encoded once


# ------------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits; 0 for ids that never occur.

    Package-merge.  One id alone gets 1 bit.  Ties go to the lower id.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids can't have codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    w = counts[order].astype(np.float64)
    n = len(w)
    # rounds[k]: the sorted list of level k as (weight, is it a package)
    rounds = []
    packages = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([w, packages])
        kind = np.concatenate([np.zeros(n, bool), np.ones(len(packages), bool)])
        at = np.argsort(both, kind="stable")
        both, kind = both[at], kind[at]
        rounds.append(kind)
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * (n - 1)
    lengths = np.zeros(n, np.int64)
    for kind in reversed(rounds):
        chosen = kind[:take]
        singles = int((~chosen).sum())
        lengths[:singles] += 1  # the lightest ids of the level
        take = 2 * int(chosen.sum())
    out[order] = lengths
    return out


class Code:
    """Canonical codes of given lengths, and the table that reads them."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths, limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order].astype(np.int64)
        step = (1 << (limit - size)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(step)])
        self.codes = np.zeros(len(lengths), U64)
        self.codes[order] = (first[:-1] >> (limit - size)).astype(U64)
        self.symbol = np.zeros(1 << limit, np.int32)
        self.size = np.zeros(1 << limit, np.uint8)
        self.symbol[: first[-1]] = np.repeat(order, step)
        self.size[: first[-1]] = np.repeat(size, step)
        self.entry = (self.symbol.astype(np.uint32) << np.uint32(8)) | self.size

    def pack(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents ids[first[i]:first[i+1]] to (bytes, byte offsets,
        checkpoints, checkpoint offsets); each document starts on a byte."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        bits = ends[first[1:]] - ends[first[:-1]]
        n_bytes = (bits + 7) // 8
        byte_off = np.concatenate([[0], np.cumsum(n_bytes)])
        owner = np.repeat(np.arange(len(bits)), np.diff(first))
        local = ends[:-1] - ends[first[:-1]][owner]
        at = local + 8 * byte_off[:-1][owner]
        word = at >> 6
        shift = (at & 63).astype(U64)
        code = self.codes[ids] << (U64(64) - size.astype(U64))
        out = np.zeros(int(byte_off[-1] + 15) // 8 + 1, U64)
        if len(ids):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[head]] |= np.bitwise_or.reduceat(code >> shift, head)
            over = np.flatnonzero(shift + size.astype(U64) > U64(64))
            out[word[over] + 1] |= code[over] << (U64(64) - shift[over])
        blocks = (np.diff(first) + BLOCK - 1) // BLOCK
        check_off = np.concatenate([[0], np.cumsum(blocks)])
        of = np.repeat(np.arange(len(blocks)), blocks)
        nth = np.arange(len(of)) - check_off[:-1][of]
        checks = local[first[:-1][of] + nth * BLOCK]
        return out.byteswap().view(np.uint8)[: byte_off[-1]], byte_off, checks.astype(np.int32), check_off

    def unpack(self, data: np.ndarray, byte_off: np.ndarray, checks: np.ndarray, check_off: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
        """The ids again; all blocks advance together, one id at a step."""
        total = int(n_ids.sum())
        out = np.zeros(total, np.int32)
        if not total:
            return out
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        of = np.repeat(np.arange(len(n_ids)), np.diff(check_off))
        nth = np.arange(len(of)) - check_off[:-1][of]
        at = checks.astype(np.int64) + 8 * byte_off[:-1][of]
        left = np.minimum(n_ids[of] - nth * BLOCK, BLOCK)
        dest = np.concatenate([[0], np.cumsum(n_ids)])[:-1][of] + nth * BLOCK
        order = np.argsort(-left, kind="stable")
        at, left, dest = at[order], left[order], dest[order]
        alive = np.searchsorted(-left, -np.arange(1, BLOCK + 1), side="right")
        mask, shift = np.uint32((1 << self.limit) - 1), 32 - self.limit
        for step in range(BLOCK):
            n = alive[step]
            if not n:
                break
            p = at[:n]
            key = (window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            got = self.entry[key]
            out[dest[:n] + step] = got >> np.uint32(8)
            at[:n] += got & np.uint32(255)
        return out


# ------------------------------------------------------------- ids of a corpus


def word_ids(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, first id of each text): the vocabulary's encoding.

    Texts are parted before each space that follows an ASCII or Latin-1
    character that is no white space, where the pattern parts them in any
    surroundings; equal parts of a batch are encoded once.
    """
    buf, off, _ = text_views(col)
    n = len(buf)
    cut = np.zeros(n, bool)
    if n:
        cut[off[:-1][off[:-1] < n]] = True
        at = np.flatnonzero(buf[1:] == 32) + 1
        before = buf[at - 1]
        cut[at[(before > 32) & (before < 127)]] = True
        at = at[(before >= 0x80) & (at >= 2)]
        cut[at[buf[at - 2] == 0xC3]] = True
    start = np.flatnonzero(cut)
    end = np.concatenate([start[1:], [n]])[: len(start)]
    h = np.empty(len(start), U64)
    bounds = np.searchsorted(start, np.arange(0, n + (1 << 20), 1 << 20))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            a, z = start[lo], end[hi - 1]
            h[lo:hi] = span_hash(buf[a:z], start[lo:hi] - a, end[lo:hi] - a)
    _, some, which = np.unique(h, return_index=True, return_inverse=True)
    data, encode = buf.tobytes(), encoding(path).encode_ordinary
    parts = [encode(data[a:z].decode()) for a, z in zip(start[some].tolist(), end[some].tolist())]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.fromiter((i for p in parts for i in p), np.int32, int(size.sum()))
    base = np.concatenate([[0], np.cumsum(size)])
    each = size[which]
    ends = np.cumsum(each)
    ids = flat[np.repeat(base[:-1][which] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids, np.concatenate([[0], ends])[np.searchsorted(start, off)]


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)``, ids packed as 4-byte integers, or 2-byte ones where
    the vocabulary has at most 65,536; null where the text is null, empty where
    it is.  A null id stays null, repeated rows are one row each, an empty table
    gives an empty one; other columns are ignored."""
    path = vocabulary or default_vocabulary()
    kind = id_type(path)

    def run(batches):
        for batch in batches:
            for lo, hi in pieces(text_views(batch.column("text"))[1], GROUP):
                part = batch.slice(lo, hi - lo)
                ids, first = word_ids(part.column("text"), path)
                out = blobs(ids.astype(kind), first)
                null = np.asarray(part.column("text").is_null())
                if null.any():
                    out = pa.array([None if z else v for z, v in zip(null.tolist(), out.to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), out], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, ids binary")


def id_type(path: str):
    return np.uint16 if len(token_bytes(path)[1]) - 1 <= 65536 else np.int32


def global_counts(tokens: DataFrame, n_ids: int, kind) -> np.ndarray:
    """How often each id occurs in all rows of ``tokens``."""

    def count(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(text_views(batch.column("ids"))[0].tobytes(), kind), minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    got = tokens.select("ids").mapInArrow(tidy(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_ids, np.int64)
    out[np.asarray(got.column("id"))] = np.asarray(got.column("n"))
    return out


def compress(tokens: DataFrame, n_ids: int, kind=np.int32, limit: int = LIMIT) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, n_ids, data, checkpoints, exact)`` and the code lengths.

    ``tokens`` has doc_id and packed ids; it is read twice.  ``data`` is the
    bit string, ``checkpoints`` 4-byte bit offsets of each block of 128 ids,
    ``exact`` that decoding gave the ids again.  Null ids give nulls, no ids
    an empty string, repeated rows one row each; ties between counts go to the
    lower id; an empty table gives an empty one; other columns are ignored.
    """
    lengths = code_lengths(global_counts(tokens, n_ids, kind), limit)
    shared = tokens.sparkSession.sparkContext.broadcast(lengths)
    width = np.dtype(kind).itemsize

    def run(batches):
        code = Code(shared.value, limit)
        for batch in batches:
            for lo, hi in pieces(text_views(batch.column("ids"))[1], SLICE):
                part = batch.slice(lo, hi - lo)
                raw, off, null = text_views(part.column("ids"))
                ids, first = np.frombuffer(raw.tobytes(), kind).astype(np.int64), off // width
                data, byte_off, checks, check_off = code.pack(ids, first)
                n = np.diff(first)
                back = code.unpack(data, byte_off, checks, check_off, n)
                wrong = np.concatenate([[0], np.cumsum(back != ids)])
                same = wrong[first[1:]] == wrong[first[:-1]]
                cols = [blobs(data, byte_off), blobs(checks, check_off)]
                if null.any():
                    cols = [pa.array([None if z else v for z, v in zip(null.tolist(), c.to_pylist())], pa.binary()) for c in cols]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, mask=null), *cols, pa.array(same, mask=null)], names=["doc_id", "n_ids", "data", "checkpoints", "exact"])

    return tokens.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, n_ids long, data binary, checkpoints binary, exact boolean"), lengths


def decompress(packed: DataFrame, lengths: np.ndarray, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, ids)`` as arrays of int; null data gives null ids, an empty
    string none.  A null doc_id stays null, repeated rows are one row each, an
    empty table gives an empty one; other columns are ignored."""
    shared = packed.sparkSession.sparkContext.broadcast(lengths)

    def run(batches):
        code = Code(shared.value, limit)
        for batch in batches:
            data, byte_off, null = text_views(batch.column("data"))
            raw, check_off, _ = text_views(batch.column("checkpoints"))
            n = np.asarray(batch.column("n_ids").fill_null(0)).astype(np.int64)
            ids = code.unpack(data, byte_off, np.frombuffer(raw.tobytes(), np.int32), check_off // 4, n)
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids), mask=pa.array(null) if null.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return packed.select("doc_id", "n_ids", "data", "checkpoints").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def op10_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_vocabulary()
    tokens = stored(tokenise(documents(spark, sf_dir), vocabulary=path), "ids")
    return compress(tokens, len(token_bytes(path)[1]) - 1, id_type(path))[0]


QUERIES = {"op10_huffman_tokens": op10_huffman_tokens}
