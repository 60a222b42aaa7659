"""BPE encoding with content-defined chunk reuse, and exact decoding.

Rolling-hash chunks: a text is cut where the hash of its last bytes says so,
hence equal passages of different documents give equal chunks.  Packs of texts
send the hashes of their chunks to buckets, which name one pack for each chunk
that several have; that pack encodes it, once, and its ids go to the others.
Each pack then joins the ids of its texts' chunks, and encodes those that it
alone has.  A join of two chunks is repaired by re-encoding the text around
it, from the nearest border that is sure to stand on its left to the nearest on
its right, where both sides agree with the whole.
"""

from __future__ import annotations

import base64
import importlib.util
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blobs, documents, mix, pieces, release, routed, shuffle_partitions, span_hash, text_views, tidy, unblob

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROLL = 16
MEAN_CHUNK = 192
CACHE_BYTES = 48 << 20
PIECE = 512 << 10
PACK = 4 << 20  # bytes of texts that are one row of the table of packs


def default_vocabulary() -> str:
    """The rank file of a public byte-level vocabulary, found beside its package."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / "byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, joined by id, and their offsets."""
    table = encoding(path)._mergeable_ranks
    parts = [b""] * (max(table.values()) + 1)
    for b, i in table.items():
        parts[i] = b
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), off


def chunk_ends(buf: np.ndarray, mean: int = MEAN_CHUNK, roll: int = ROLL) -> np.ndarray:
    """Offsets at which the hash of the ``roll`` bytes before says to cut; never
    inside a character."""
    n = len(buf) - roll
    if n <= 0:
        return np.zeros(0, np.int64)
    table = mix(np.arange(256, dtype=U64) + U64(1)).astype(np.uint32)
    x = table[buf]
    # a buzhash of each window, by doubling: roll is a power of two
    width = 1
    while width < roll:
        turn = np.uint32(width)
        x = ((x[:-width] << turn) | (x[:-width] >> np.uint32(32 - width))) ^ x[width:]
        width *= 2
    at = np.flatnonzero(x[:-1] % np.uint32(mean) == 0) + roll
    return at[(buf[at] & 0xC0) != 0x80]


class Encoder:
    """Encodes texts chunk by chunk, with the ids of ``known`` chunks by hash
    and a bounded store of its own."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES, mean: int = MEAN_CHUNK, known: dict[int, array] | None = None):
        self.enc = encoding(path)
        self.encode = lambda text, plain=self.enc.encode_ordinary: array("i", plain(text))
        self.sizes = np.diff(token_bytes(path)[1]).tolist()
        self.cache_bytes, self.mean = cache_bytes, mean
        self.old: dict[str, array] = {}
        self.new: dict[str, array] = {}
        self.held = 0
        self.known = known or {}
        self.reused = self.repaired = 0

    def chunk(self, text: str, hash_: int | None) -> array:
        ids = self.known.get(hash_)
        if ids is not None:
            self.reused += 1
            return ids
        ids = self.new.get(text)
        if ids is None:
            ids = self.old.pop(text, None)
            if ids is None:
                ids = self.encode(text)
            else:
                self.reused += 1
            self.new[text] = ids
            self.held += 4 * len(ids) + len(text) + 400
            if self.held > self.cache_bytes:  # keep what was used lately
                self.old, self.new, self.held = self.new, {}, 0
        else:
            self.reused += 1
        return ids

    def text(self, text: str, ends: list[int], hashes: list[int]) -> array:
        """The ids of a text cut at character offsets ``ends``, into chunks of
        the given hashes.

        ``out`` always is the encoding of the text so far.  A border is sure
        where a space follows what is none: the pattern splits there in
        whatever surroundings.  A chunk without one is joined to the next, so
        a join re-encodes from the last sure border of the chunk before it to
        the first one of the chunk behind it.
        """
        out = array("i")
        sizes, lo, begin, find = self.sizes, 0, 0, text.find
        for hi, hash_ in zip([*ends, len(text)], hashes):
            if hi == lo:
                continue
            if lo != begin:  # joined to the one before
                hash_ = None
            begin = hi
            q = find(" ", lo + 1, hi)
            while q >= 0 and text[q - 1].isspace():
                q = find(" ", q + 1, hi)
            if q < 0:
                if hi < len(text):
                    continue
                q = hi
            ids = self.chunk(text[lo:hi], hash_)
            if lo and (text[lo] != " " or text[lo - 1].isspace()):
                p = text.rfind(" ", 0, lo)
                while text[p - 1].isspace():
                    p = text.rfind(" ", 0, p)
                drop, keep = len(text[p:lo].encode()), len(text[lo:q].encode())
                old = 0
                while drop > 0:
                    old += 1
                    drop -= sizes[out[-old]]
                cut = 0
                while keep > 0:
                    keep -= sizes[ids[cut]]
                    cut += 1
                middle = self.encode(text[p:q])
                if old:
                    self.repaired += middle != out[-old:] + ids[:cut]
                    del out[-old:]
                out += middle
                out += ids[cut:]
            else:
                out += ids
            lo = hi
        return out


# lead bytes of characters among which some are white space
_SPACED = np.zeros(256, bool)
_SPACED[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _sure(buf: np.ndarray) -> np.ndarray:
    """Offsets of spaces behind a character that is certainly no white space."""
    at = np.flatnonzero(buf[1:] == 32) + 1
    before = buf[at - 1]
    good = (before > 32) & (before < 127)
    wide = np.flatnonzero(before >= 0x80)
    lead = before[wide]
    for back in (2, 3, 4):
        more = (lead & 0xC0) == 0x80
        lead = np.where(more, buf[np.maximum(at[wide] - back, 0)], lead)
    good[wide] = (lead >= 0xC0) & ~_SPACED[lead]
    return at[good]


def cut(part: np.ndarray, o: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the chunks of texts part[o[i]:o[i+1]], all but the
    last of a text with a sure border inside.  A window that decides a cut lies
    in one text, so that equal texts are cut alike."""
    at = chunk_ends(part, mean)
    owner = np.minimum(np.searchsorted(o, at, "right") - 1, len(o) - 2)
    at = at[at - ROLL >= o[owner]]
    borders = np.unique(np.concatenate([o[:-1], at]))
    sure = _sure(part)
    keep = np.ones(len(borders), bool)
    keep[1:] = np.searchsorted(sure, borders[1:]) > np.searchsorted(sure, borders[:-1] + 1)
    keep[np.searchsorted(borders, o[:-1])] = True
    start = borders[keep]
    start = start[start < len(part)]
    end = np.concatenate([start[1:], [len(part)]])[: len(start)]
    return start, end, span_hash(part, start, end) if len(start) else np.zeros(0, U64)


def encode_batch(col: pa.Array, encoder: Encoder) -> list[array | None]:
    out: list[array | None] = []
    buf, off, null = text_views(col)
    for lo, hi in pieces(off):
        part = buf[off[lo] : off[hi]]
        o = off[lo : hi + 1] - off[lo]
        data = part.tobytes()
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        start, end, hashes = cut(part, o, encoder.mean)
        at = np.searchsorted(start, o)
        ends = (chars[end] - chars[o[np.searchsorted(o, start, "right") - 1]]).tolist()
        hashes = hashes.tolist()
        for i in range(hi - lo):
            if null[lo + i]:
                out.append(None)
            else:
                a, z = at[i], at[i + 1]
                out.append(encoder.text(data[o[i] : o[i + 1]].decode(), ends[a : z - 1], hashes[a:z]))
    return out


def decode_ids(flat: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each id) of an array of ids, by table."""
    data, off = token_bytes(path)
    size = np.diff(off)[flat]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if max(total, len(data)) < 1 << 31 else np.int64
    at = np.repeat((off[:-1][flat] - (end - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return data[at], size


def _lists(ids: list[array | None]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
    sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in ids if x)])
    mask = pa.array([x is None for x in ids], pa.bool_()) if any(x is None for x in ids) else None
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=mask), flat, off


# ------------------------------------------------------ chunks of all documents


def _packs(batches):
    """(id, text) rows to packs of texts: ids and whether known, sizes (-1 for
    null), and the texts, compressed."""
    at, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        buf, off, null = text_views(batch.column("text"))
        ids = batch.column("id")
        for lo, hi in pieces(off, PACK):
            some = ids.slice(lo, hi - lo)
            pair = np.stack([np.asarray(some.is_valid()).astype(np.int64), np.asarray(some.fill_null(0)).astype(np.int64)])
            size = np.where(null[lo:hi], -1, np.diff(off[lo : hi + 1]))
            one = np.array([0, 1])
            text = pa.compress(buf[off[lo] : off[hi]].tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | at]), blobs(pair.reshape(1, -1), one), blobs(size.reshape(1, -1), one), pa.array([text], pa.binary())], names=["pack", "ids", "size", "text"])
            at += 1


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of a pack's texts."""
    size = np.frombuffer(row["size"], np.int64)
    n = int(np.maximum(size, 0).sum())
    return np.frombuffer(pa.decompress(row["text"], n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8), size


def _chunks(buf: np.ndarray, off: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the distinct chunks of texts buf[off[i]:off[i+1]]."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
    for lo, hi in pieces(off):
        a, z, h = cut(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], mean)
        found.append((a + off[lo], z + off[lo], h))
    start, end, h = (np.concatenate(x) for x in zip(*found))
    h, first = np.unique(h, return_index=True)
    return start[first], end[first], h


def _hashes(batches, mean: int, buckets: int):
    """The hashes of each pack's chunks, by bucket."""
    at, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        buf, off, _ = text_views(batch.column("text"))
        for lo, hi in pieces(off, PACK):
            h = _chunks(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], mean)[2]
            order, which, edge = routed((h % U64(buckets)).astype(np.int64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.full(len(which), (task << 32) | at)), blobs(h[order], edge)], names=["bucket", "pack", "hash"])
            at += 1


def _holders(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, pack, is it the least pack that has it) of a bucket's chunks that
    several packs have, ordered by pack."""
    h, n = unblob(t.column("hash"), U64)
    pack = np.repeat(np.asarray(t.column("pack")), n)
    order = np.lexsort((pack, h))
    h, pack = h[order], pack[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    shared = ~head | np.concatenate([~head[1:], [False]])[: len(h)]
    h, pack, head = h[shared], pack[shared], head[shared]
    order = np.argsort(pack, kind="stable")
    return h[order], pack[order], head[order]


def _by_pack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]])) if len(pack) else np.zeros(0, np.int64)
    return pack[edge], np.concatenate([edge, [len(pack)]]).astype(np.int64)


def _owners(t: pa.Table) -> pa.Table:
    """To packs, the chunks that they encode for all."""
    h, pack, own = _holders(t)
    packs, cuts = _by_pack(pack[own])
    return pa.table({"pack": pa.array(packs), "own": blobs(h[own], cuts)})


def _encode_own(own: pa.Table, asked: pa.Table, path: str, mean: int, buckets: int) -> pa.Table:
    """The ids of a pack's chunks that others have too, by bucket."""
    want = np.sort(unblob(asked.column("own"), U64)[0]) if asked.num_rows else np.zeros(0, U64)
    hashes, ids = [], []
    encode = encoding(path).encode_ordinary
    for row in own.to_pylist() if len(want) else []:
        buf, size = _unpack(row)
        start, end, h = _chunks(buf, np.concatenate([[0], np.cumsum(np.maximum(size, 0))]), mean)
        mine = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h
        hashes.append(h[mine])
        ids += [np.array(encode(buf[a:z].tobytes().decode()), np.int32) for a, z in zip(start[mine].tolist(), end[mine].tolist())]
    h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    order, which, cuts = routed((h % U64(buckets)).astype(np.int64), buckets)
    ids = [ids[k] for k in order.tolist()]
    release()
    return pa.table({"bucket": pa.array(which.astype(np.int32)), **_sent(h[order], ids, cuts)})


def _sent(h: np.ndarray, ids: list[np.ndarray], cuts: np.ndarray) -> dict[str, pa.Array]:
    flat = [pa.compress(np.concatenate(ids[a:z]).tobytes(), "zstd", asbytes=True) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return {"hash": blobs(h, cuts), "n": blobs(np.array([len(x) for x in ids], np.int32), cuts), "flat": pa.array(flat, pa.binary())}


def _route(t: pa.Table, encoded: pa.Table) -> pa.Table:
    """To each pack, the ids of its chunks that several packs have."""
    known = _known(encoded.to_pylist())
    h, pack, _ = _holders(t)
    ids = [known.get(x) for x in h.tolist()]
    there = np.array([x is not None for x in ids], bool)
    packs, cuts = _by_pack(pack[there])
    return pa.table({"pack": pa.array(packs), **_sent(h[there], [np.frombuffer(x, np.int32) for x in ids if x is not None], cuts)})


def _known(rows: list[dict]) -> dict[int, array]:
    """Ids by hash, of what ``_sent`` packed."""
    out: dict[int, array] = {}
    for r in rows:
        n = np.frombuffer(r["n"], np.int32)
        ids = array("i", pa.decompress(r["flat"], 4 * int(n.sum()), "zstd", asbytes=True))
        ends = np.cumsum(n).tolist()
        for h, a, z in zip(np.frombuffer(r["hash"], U64).tolist(), [0, *ends[:-1]], ends):
            out[h] = ids[a:z]
    return out


def _rows(doc_id: pa.Array, col: pa.Array, encoder: Encoder, path: str) -> pa.RecordBatch:
    """Encoded rows; ``exact`` says that their ids decode to their text."""
    lists, data, same = [], None, None
    for _ in range(2):
        lists = encode_batch(col, encoder) if data is None else [encoder.encode(t) if t is not None and not s else x for t, s, x in zip(col.to_pylist(), same, lists)]
        ids, flat, off = _lists(lists)
        buf, at, null = text_views(col)
        data, size = decode_ids(flat, path)
        ends = np.concatenate([[0], np.cumsum(size)])[off]
        same = ends[1:] - ends[:-1] == at[1:] - at[:-1]
        if len(data) == len(buf) and same.all():
            wrong = np.concatenate([[0], np.cumsum(data != buf)])
            same &= wrong[at[1:]] == wrong[at[:-1]]
        else:
            same &= [data[ends[i] : ends[i + 1]].tobytes() == buf[at[i] : at[i + 1]].tobytes() for i in range(len(same))]
        if same.all():
            break  # else two chunks had one hash: those texts are encoded directly
    return pa.RecordBatch.from_arrays([doc_id, ids, pa.array(np.diff(off), mask=null), pa.array(same, mask=null)], names=["doc_id", "ids", "n_tokens", "exact"])


_RESULT = "doc_id long, ids array<int>, n_tokens long, exact boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("exact", pa.bool_())])


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    mean_chunk: int = MEAN_CHUNK,
) -> DataFrame:
    """``(doc_id, ids, n_tokens, exact)`` for every row of ``docs``.

    ``ids`` equals the vocabulary's encoding of the whole text; ``exact`` says
    that decoding them gave the text's bytes again.  A null text has null ids,
    n_tokens and exact; an empty one has no ids.  A null id stays null,
    repeated rows are each encoded (their chunks once), an empty table gives an
    empty one, other columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # each of these two is shuffled once and read twice: Spark reuses the exchange
    packs = rows.mapInArrow(tidy(_packs), "pack long, ids binary, size binary, text binary").groupBy("pack")
    hashes = rows.mapInArrow(tidy(lambda it: _hashes(it, mean_chunk, buckets)), "bucket int, pack long, hash binary").groupBy("bucket")
    owners = hashes.applyInArrow(_owners, "pack long, own binary")
    coded = packs.cogroup(owners.groupBy("pack")).applyInArrow(lambda x, y: _encode_own(x, y, path, mean_chunk, buckets), "bucket int, hash binary, n binary, flat binary")
    known = hashes.cogroup(coded.groupBy("bucket")).applyInArrow(_route, "pack long, hash binary, n binary, flat binary")

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        encoder = Encoder(path, mean=mean_chunk, known=_known(got.to_pylist()))
        out = []
        for row in own.to_pylist():
            buf, size = _unpack(row)
            pair = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
            off = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            col = pa.StringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(buf), pa.array(size >= 0).buffers()[1])
            ids = pa.array(pair[1], mask=pair[0] == 0)
            out += [_rows(ids.slice(lo, hi - lo), col.slice(lo, hi - lo), encoder, path) for lo, hi in pieces(off, PIECE)]
        release()
        return pa.Table.from_batches(out, _SCHEMA)

    return packs.cogroup(known.groupBy("pack")).applyInArrow(finish, _RESULT)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)``: the texts of id lists.  Null ids give a null text,
    no ids an empty one; bytes that are no UTF-8 become replacement characters.
    A null doc_id stays null, repeated rows are each decoded, an empty table
    gives an empty one, other columns are ignored."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        for batch in batches:
            col = batch.column("ids")
            flat = np.asarray(col.flatten()).astype(np.int64)
            n = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
            data, size = decode_ids(flat, path)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            null = np.asarray(col.is_null())
            texts = [None if null[i] else data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace") for i in range(len(n))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


QUERIES = {"op4_chunked_bpe": op4_chunked_bpe}
