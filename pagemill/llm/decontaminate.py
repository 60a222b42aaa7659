"""Benchmark decontamination by template canonicalisation.

Numbers (in digits or words), names and units become typed placeholders, so a
question with other numbers or names has the same template.  Windows of a
template are hash-joined with those of the benchmark, and the values in the
slots must correspond: one value of the item always meets the same value of the
document, and two names or units of the item never meet the same one.

A name is a capitalised word, at the start of a sentence too unless it is a
function word; in scripts without case names are plain words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, blobs, documents, each_piece, mix, stored, tidy, unblob, window_hash, windows_inside

WINDOW = 8
SHORTEST = 5
LEAST_COVERAGE = 0.3
BROADCAST_BYTES = 64 << 20

UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees mph kph kmh watt watts volt volts joule joules newton newtons"
).split()
_NUMBER, _NAME, _UNIT, _PLAIN = (mix(np.array([i], U64))[0] for i in (11, 22, 33, 44))
NUMBER_WORDS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil"
).split()
FUNCTION_WORDS = (
    "a an the this that these those there here it its he she we they i you his her their our my your one some any each every all both no not if when while after before since because as at by for from in into of on over under "
    "to with without and or but so then thus how what which who whom whose why where is are was were be been do does did has have had can could will would shall should may might must let given suppose find compute calculate "
    "der die das ein eine einer eines einem einen dies diese dieser es er sie wir ihr ich wenn wie was wer wo warum welche welcher und oder aber in im auf an am mit ohne von zu bei nach vor für ist sind war hat haben kann "
    "le la les un une des du de ce cet cette ces il elle ils elles nous vous je on si quand comment quel quelle qui que où pourquoi et ou mais dans sur avec sans par pour est sont a ont "
    "el los las uno una unos unas este esta estos estas lo ella ellos yo tú si cuando cómo qué quién dónde y o pero en con sin por para es son ha han"
).split()


def _hashes(words: list[str]) -> np.ndarray:
    text = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(Words(text, np.array([0, len(text)])).hash)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


_UNIT_HASH, _NUMBER_HASH, _FUNCTION_HASH = _hashes(UNITS), _hashes(NUMBER_WORDS), _hashes(FUNCTION_WORDS)
# [first byte, second byte] of capital letters: Latin, Greek, Cyrillic, Armenian
_CAPITAL = np.zeros((256, 256), bool)
for _c in map(chr, range(0x41, 0x587)):
    if _c.isupper():
        _b = _c.encode()
        _CAPITAL[_b[0], _b[1] if len(_b) > 1 else slice(None)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n|\"("]] = True


PLAIN, NUMBER, NAME, UNIT = range(4)


def templates(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(typed hash of each word, its kind of slot or PLAIN)."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    head = w.buf[w.starts]
    second = w.buf[np.minimum(w.starts + 1, len(w.buf) - 1)]
    number = ((head >= 48) & (head <= 57)) | _among(w.hash, _NUMBER_HASH)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.buf])])
    opens = np.ones(n, bool)
    opens[1:] = stops[w.starts[1:]] > stops[w.ends[:-1]]
    opens[w.first[:-1][w.first[:-1] < n]] = True
    shouted = _UPPER[second] & (w.ends - w.starts > 1)
    name = _CAPITAL[head, second] & ~shouted & ~number
    at = np.flatnonzero(name & opens)
    name[at[_among(w.hash[at], _FUNCTION_HASH)]] = False
    after = np.zeros(n, bool)
    after[1:] = number[:-1]
    unit = np.zeros(n, bool)
    at = np.flatnonzero(after & ~number)
    unit[at] = _among(w.hash[at], _UNIT_HASH)
    typed, kind = w.hash.copy(), np.zeros(n, np.uint8)
    for on, sign, k in ((name, _NAME, NAME), (unit, _UNIT, UNIT), (number, _NUMBER, NUMBER)):
        typed[on], kind[on] = sign, k
    return typed, kind


def _windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of k words: first of the templates that
    are at least half no slots (from SHORTEST words on), then of all as plain
    words; and how many are templates, and each word's kind of slot."""
    at = windows_inside(w.first, k)
    if not len(at):
        return at, np.zeros(0, U64), 0, np.zeros(len(w.starts), np.uint8)
    plain = window_hash(w.hash ^ _PLAIN, k)[at] ^ U64(k)
    typed, slot = templates(w)
    slots = np.concatenate([[0], np.cumsum(slot > PLAIN)])
    loose = at[(slots[at + k] - slots[at]) * 2 <= k] if k >= SHORTEST else at[:0]
    return np.concatenate([loose, at]), np.concatenate([window_hash(typed, k)[loose] ^ U64(k), plain]), len(loose), slot


class Index:
    """The benchmark's windows, sorted by hash.

    Each distinct text of an item has windows and totals of its own: ``item``
    numbers the (item, text) pairs, ``owner`` has their items.
    """

    def __init__(self, items: list[tuple[int, str]], k: int):
        rows = []
        self.total: dict[int, np.ndarray] = {}  # windows that are templates, and all
        pairs = list(dict.fromkeys(items))
        self.owner = np.array([p[0] for p in pairs], np.int64)
        for number, (_, text) in enumerate(pairs):
            data = np.frombuffer(text.encode(), np.uint8)
            w = Words(data, np.array([0, len(data)]))
            size = min(k, len(w.starts))
            if not size:
                continue
            at, h, loose, slot = _windows(w, size)
            self.total[number] = np.array([loose, len(at) - loose])
            both = set(at[:loose].tolist())
            for n, (i, x) in enumerate(zip(at.tolist(), h.tolist())):
                toks = np.zeros(k, U64)
                toks[:size] = w.hash[i : i + size]
                mask = np.zeros(k, np.uint8)
                mask[:size] = slot[i : i + size] * (n < loose)
                rows.append((x, number, i, size, toks, mask, i in both))
        rows.sort(key=lambda r: r[:3])
        self.k = k
        self.hash = np.array([r[0] for r in rows], U64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)
        self.words = np.array([r[4] for r in rows], U64).reshape(-1, k)
        self.slot = np.array([r[5] for r in rows], np.uint8).reshape(-1, k)
        self.size = np.array([r[3] for r in rows], np.int32)
        self.sizes = sorted(set(self.size.tolist()))
        self.loose = np.array([r[6] for r in rows], bool)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash & U64((1 << 20) - 1)).astype(np.int64)] = True

    def join(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of h, row of the index) of equal hashes."""
        cand = np.flatnonzero(self.maybe[(h & U64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[cand], "left"), np.searchsorted(self.hash, h[cand], "right")
        n = hi - lo
        left = np.repeat(cand, n)
        right = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return left, right


_OUT = ["doc_id", "item_id", "matched", "windows", "coverage", "kind"]
_OUT_TYPE = "doc_id long, item_id long, matched long, windows long, coverage double, kind string"


def _judge(doc, item, at, words, item_words, slot, loose, total, least) -> list[tuple]:
    """Matches of one document and one item to (matched, coverage, kind).

    A window counts where each of its slots agrees with the value that most
    windows give for that item value, or where its plain words are equal.
    Coverage is that of the windows with a template or that of all windows,
    whichever is more.
    """
    votes: dict[int, dict[int, int]] = {}
    ii, jj = np.nonzero(slot)
    for a, b in zip(item_words[ii, jj].tolist(), words[ii, jj].tolist()):
        votes.setdefault(a, {}).setdefault(b, 0)
        votes[a][b] += 1
    best = {a: max(v, key=lambda b: (v[b], b)) for a, v in votes.items()}
    # of names and units that meet one value, the one that most windows give
    back: dict[int, int] = {}
    for a in {int(item_words[i, j]) for i, j in zip(ii, jj) if slot[i, j] != NUMBER}:
        b = best[a]
        if b not in back or (votes[a][b], a) > (votes[back[b]][b], back[b]):
            back[b] = a
    bad = np.zeros(len(at), bool)
    changed = False
    for i, j in zip(ii.tolist(), jj.tolist()):
        a, b = int(item_words[i, j]), int(words[i, j])
        if best[a] != b or (slot[i, j] != NUMBER and back[b] != a):
            bad[i] = True
        elif a != b:
            changed = True
    found = ((len(np.unique(at[~bad & loose])), int(total[0])), (len(np.unique(at[~bad])), int(total[1])))
    matched, windows = max((x for x in found if x[1]), key=lambda x: (x[0] / x[1], x[1]))
    if matched / windows >= least:
        return [(doc, item, matched, windows, matched / windows, "reparameterised" if changed else "exact")]
    return []


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    types = [pa.int64()] * 4 + [pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=_OUT)


def _best(rows: list[tuple]) -> list[tuple]:
    """Of one document's matches, that of each item's best covered text."""
    best: dict[int, tuple] = {}
    for row in rows:
        if row[1] not in best or (row[4], row[3], row[5]) > (best[row[1]][4], best[row[1]][3], best[row[1]][5]):
            best[row[1]] = row
    return list(best.values())


def _groups(doc: np.ndarray, item: np.ndarray):
    order = np.lexsort((item, doc))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0)])) if len(order) else []
    return np.split(order, edge[1:]) if len(order) else []


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(doc_id, item_id, matched, windows, coverage, kind)``: leaked items.

    ``coverage`` is the share of the item's windows that the document has with
    corresponding slot values; pairs under ``least_coverage`` are left out.
    ``kind`` is ``exact`` or ``reparameterised``.  Windows that are mostly slots
    match only where all words are equal.  Items under ``window`` words are one
    window, those of 1 to 4 words match only with equal words, wherever a
    document has them; items without words match nothing.  Rows with a null id or
    text, on either side, match nothing.  Repeated rows of the
    benchmark count once; several texts with one item id are each judged by
    their own windows, and the best covered one is given.  Documents that share an id are judged each by itself,
    and equal result rows are given once.  The
    benchmark is broadcast while its text is within ``broadcast_bytes``;
    beyond, both sides' windows meet in a shuffle.  Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _shuffled(docs, items, window, least_coverage)
    index = spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], window))

    def match(batches):
        x = index.value
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            rows = []
            for lo, _, w in each_piece(batch.column("text")):
                parts = []
                for k in x.sizes:
                    at, h, _, _ = _windows(w, k)
                    left, right = x.join(h)
                    parts.append((at[left], right))
                at, right = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
                if not len(at):
                    continue
                words = w.hash[np.minimum(at[:, None] + np.arange(x.k), len(w.hash) - 1)]
                doc, item = w.doc[at], x.item[right]
                of_doc: dict[int, list[tuple]] = {}
                for g in _groups(doc, item):
                    r = right[g]
                    of_doc.setdefault(int(doc[g[0]]), []).extend(_judge(int(ids[lo + doc[g[0]]]), int(x.owner[item[g[0]]]), x.at[r], words[g], x.words[r], x.slot[r], x.loose[r], x.total[int(item[g[0]])], least_coverage))
                for matches in of_doc.values():
                    rows += _best(matches)
            yield _table(rows)

    return docs.mapInArrow(tidy(match), _OUT_TYPE).distinct()


def _filter(windows: DataFrame) -> np.ndarray:
    """A bit for each hash (by its low bits) that a window of the benchmark
    has: 16 bits a window, at most 2^30 of them, 64 bits a row of ``h``."""
    n = windows.count()
    size = 1 << min(30, max(10, (16 * n - 1).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    words = windows.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[np.asarray(words.column("at"))] = np.asarray(words.column("bits"))
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool) if size <= 1 << 24 else out.view(U64)


def _passes(maybe: np.ndarray, h: np.ndarray) -> np.ndarray:
    if maybe.dtype == bool:
        return maybe[(h & U64(len(maybe) - 1)).astype(np.int64)]
    word = maybe[((h & U64(64 * len(maybe) - 1)) >> U64(6)).astype(np.int64)]
    return ((word >> (h & U64(63))) & U64(1)).astype(bool)


def _shuffled(docs: DataFrame, items: DataFrame, k: int, least: float) -> DataFrame:
    """The same with a shuffle join on the window hash; windows of documents
    whose hash no item has are dropped before, by a filter of bits."""
    spark = docs.sparkSession

    def of_items(batches):
        for batch in batches:
            x = Index(list(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())), k)
            keys = np.asarray(batch.column("key"))  # one row for each pair: they are distinct
            totals = np.array([x.total.get(i, (0, 0)) for i in range(len(x.owner))], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.hash.view(np.int64)), pa.array(x.owner[x.item]), pa.array(keys[x.item]), pa.array(totals[x.item, 0]), pa.array(totals[x.item, 1]), pa.array(x.at), pa.array(x.size), pa.array(x.loose), blobs(x.words, np.arange(len(x.item) + 1)), blobs(x.slot, np.arange(len(x.item) + 1))],
                names=["h", "item", "key", "templates", "total", "at", "size", "loose", "iw", "slot"],
            )

    windows = items.withColumn("key", F.xxhash64("text")).mapInArrow(tidy(of_items), "h long, item long, key long, templates long, total long, at long, size int, loose boolean, iw binary, slot binary")
    windows = stored(windows, "item-windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())
    maybe = spark.sparkContext.broadcast(_filter(windows))

    def of_docs(batches):
        for batch in batches:
            ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("row"))
            for lo, _, w in each_piece(batch.column("text")):
                row = np.arange(lo, lo + len(w.first) - 1)
                for size in sizes:
                    at, h, _, _ = _windows(w, size)
                    hit = _passes(maybe.value, h)
                    at, h = at[hit], h[hit]
                    words = w.hash[np.minimum(at[:, None] + np.arange(k), max(len(w.hash) - 1, 0))] if len(at) else np.zeros((0, k), U64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[row[w.doc[at]]]), pa.array(keys[row[w.doc[at]]]), blobs(words, np.arange(len(at) + 1))], names=["h", "id", "row", "dw"])

    met = docs.withColumn("row", F.xxhash64("text")).mapInArrow(tidy(of_docs), "h long, id long, row long, dw binary").join(windows, "h")

    def score(t: pa.Table) -> pa.Table:
        n = t.num_rows
        iw, dw = (unblob(t.column(c), U64)[0].reshape(n, k) for c in ("iw", "dw"))
        slot = unblob(t.column("slot"), np.uint8)[0].reshape(n, k)
        loose = np.asarray(t.column("loose")).astype(bool)
        at, key = np.asarray(t.column("at")), np.asarray(t.column("key"))
        doc, item = (t.column(c)[0].as_py() for c in ("id", "item"))
        matches = []
        for one in np.unique(key):
            g = np.flatnonzero(key == one)
            total = [t.column(c)[int(g[0])].as_py() for c in ("templates", "total")]
            matches += _judge(doc, item, at[g], dw[g], iw[g], slot[g], loose[g], total, least)
        return pa.Table.from_batches([_table(_best(matches))])

    return met.groupBy("id", "item", "row").applyInArrow(score, _OUT_TYPE).distinct()


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op2_template_decontamination": op2_template_decontamination}
