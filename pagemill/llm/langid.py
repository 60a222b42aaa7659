"""Language spans: script ranges narrow the candidates of each word, and a
Viterbi path over per-word scores, with a penalty for switching, labels runs.

A script's candidates are the languages whose labelled documents are written
in it; a script that none is written in has a language by default.  A word's
score in a labelled language is the log-likelihood of its byte trigrams (with
word edges) under counts of all labelled documents; a default language needs
no counts.  The state ``und`` scores trigrams uniformly, so it wins where no
language fits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import Words, documents, free_name, pieces, text_views, tidy

SLOTS = 1 << 16
SWITCH = 14.0
SMOOTH = 0.5
UND = "und"
GROUP = 4 << 20  # bytes of texts whose paths advance together

SCRIPT_SHARE = 0.05  # of a language's labelled words in a script, from which it is a candidate there

# Lead bytes and second-byte ranges of the UTF-8 ranges of each script, and the
# languages by default; the first is taken where nothing tells them apart.
SCRIPTS = {
    "Greek": (["el"], [(0xCD, 0xB0, 0xBF), (0xCE, 0x80, 0xBF), (0xCF, 0x80, 0xBF)]),
    "Cyrillic": (["ru"], [(0xD0, 0x80, 0xBF), (0xD1, 0x80, 0xBF), (0xD2, 0x80, 0xBF), (0xD3, 0x80, 0xBF)]),
    "Armenian": (["hy"], [(0xD4, 0xB0, 0xBF), (0xD5, 0x80, 0xBF)]),
    "Hebrew": (["he"], [(0xD6, 0x90, 0xBF), (0xD7, 0x80, 0xBF)]),
    "Arabic": (["ar"], [(0xD8, 0x80, 0xBF), (0xD9, 0x80, 0xBF), (0xDA, 0x80, 0xBF), (0xDB, 0x80, 0xBF)]),
    "Devanagari": (["hi"], [(0xE0, 0xA4, 0xA5)]),
    "Bengali": (["bn"], [(0xE0, 0xA6, 0xA7)]),
    "Gurmukhi": (["pa"], [(0xE0, 0xA8, 0xA9)]),
    "Gujarati": (["gu"], [(0xE0, 0xAA, 0xAB)]),
    "Tamil": (["ta"], [(0xE0, 0xAE, 0xAF)]),
    "Telugu": (["te"], [(0xE0, 0xB0, 0xB1)]),
    "Kannada": (["kn"], [(0xE0, 0xB2, 0xB3)]),
    "Malayalam": (["ml"], [(0xE0, 0xB4, 0xB5)]),
    "Sinhala": (["si"], [(0xE0, 0xB6, 0xB7)]),
    "Thai": (["th"], [(0xE0, 0xB8, 0xB9)]),
    "Lao": (["lo"], [(0xE0, 0xBA, 0xBB)]),
    "Tibetan": (["bo"], [(0xE0, 0xBC, 0xBF)]),
    "Burmese": (["my"], [(0xE1, 0x80, 0x81)]),
    "Georgian": (["ka"], [(0xE1, 0x82, 0x83)]),
    "Ethiopic": (["am"], [(0xE1, 0x88, 0x8D)]),
    "Khmer": (["km"], [(0xE1, 0x9E, 0x9F)]),
    "Kana": (["ja"], [(0xE3, 0x81, 0x83)]),
    "Han": (["zh", "ja"], [(0xE3, 0x90, 0xBF), (0xE4, 0x80, 0xBF), (0xE5, 0x80, 0xBF), (0xE6, 0x80, 0xBF), (0xE7, 0x80, 0xBF), (0xE8, 0x80, 0xBF), (0xE9, 0x80, 0xBF)]),
    "Hangul": (["ko"], [(0xEA, 0xB0, 0xBF), (0xEB, 0x80, 0xBF), (0xEC, 0x80, 0xBF), (0xED, 0x80, 0x9F)]),
}
N_SCRIPTS = 1 + len(SCRIPTS)  # Latin, and all that has no range here, is 0


def _script(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first letter: 0 Latin, or 1 + its index."""
    out = np.zeros(len(starts), np.int8)
    head = buf[starts]
    odd = np.flatnonzero(head >= 0xCD)
    if len(odd):
        out[odd] = _TABLE[head[odd], buf[np.minimum(starts[odd] + 1, len(buf) - 1)]]
    return out


def _script_table() -> np.ndarray:
    out = np.zeros((256, 256), np.int8)
    for k, (_, ranges) in enumerate(SCRIPTS.values()):
        for lead, lo, hi in ranges:
            out[lead, lo : hi + 1] = k + 1
    return out


_TABLE = _script_table()


def _trigrams(w: Words, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram slot of each word byte, first byte of each word among them)."""
    n = len(w.low)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = np.zeros(n + 1, np.int8)
    np.add.at(letter, w.starts, 1)
    np.add.at(letter, w.ends, -1)
    inside = np.cumsum(letter[:-1]).astype(bool)
    x = np.where(inside, w.low, 32).astype(np.uint32)
    prev, nxt = np.empty(n, np.uint32), np.empty(n, np.uint32)
    prev[0], prev[1:] = 32, x[:-1]
    nxt[-1], nxt[:-1] = 32, x[1:]
    edge = off[(off > 0) & (off < n)]
    prev[edge] = 32
    nxt[edge - 1] = 32
    at = np.flatnonzero(inside)
    tri = (prev[at] << 16) | (x[at] << 8) | nxt[at]
    slot = ((tri * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return slot, np.concatenate([[0], np.cumsum(w.ends - w.starts)[:-1]])


def _doc_pieces(col: pa.Array, most: int):
    buf, off, _ = text_views(col)
    for lo, hi in pieces(off, most):
        o = off[lo : hi + 1] - off[lo]
        yield lo, hi, o, Words(buf[off[lo] : off[hi]], o)


class Model:
    """Log-likelihoods [labelled languages and ``und``, slots], and which
    languages each script has: ``written`` [languages, scripts]."""

    def __init__(self, langs: list[str], logp: np.ndarray, written: np.ndarray):
        self.langs, self.logp, self.written = langs, logp, written
        self.by_default: dict[int, list[int]] = {}
        own: list[str] = []
        for k, (defaults, _) in enumerate(SCRIPTS.values()):
            if not written[:, k + 1].any():
                own += [d for d in defaults if d not in own and d not in langs]
        self.states = [*langs, *own, UND]
        for k, (defaults, _) in enumerate(SCRIPTS.values()):
            if not written[:, k + 1].any():
                self.by_default[k + 1] = [self.states.index(d) for d in defaults]


def fit(docs: DataFrame, text_col: str, lang_col: str, slots: int = SLOTS, smooth: float = SMOOTH, script_share: float = SCRIPT_SHARE) -> Model:
    """Counts of trigrams and of words by script, of every labelled document;
    counts come to the driver, at most ``slots`` and one a script for a
    language, however large the corpus is."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    wide = slots + N_SCRIPTS

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            names, code = lang.dictionary.to_pylist(), np.asarray(lang.indices)
            for lo, hi, off, w in _doc_pieces(batch.column("text"), 1 << 20):
                slot, heads = _trigrams(w, off)
                of_word = code[lo:hi][w.doc]
                own = np.repeat(of_word, w.ends - w.starts) if len(slot) else np.zeros(0, np.int64)
                c = np.bincount(own * wide + slot, minlength=len(names) * wide)
                c += np.bincount(of_word * wide + slots + _script(w.buf, w.starts), (~_bare(w)).astype(float), len(names) * wide).astype(np.int64)
                for name, x in zip(names, c.reshape(len(names), wide)):
                    total[name] = total.get(name, 0) + x
        for name, x in total.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], names=["lang", "slot", "n"])

    got = rows.mapInArrow(tidy(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("c")).orderBy("lang").toArrow()
    langs = got.column("lang").to_pylist()
    counts = np.zeros((len(langs), wide))
    for k in range(len(langs)):
        c = got.column("c")[k].values
        counts[k, np.asarray(c.field("slot"))] = np.asarray(c.field("n"))
    counts, scripts = counts[:, :slots], counts[:, slots:]
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    logp = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * seen))
    written = scripts >= np.maximum(script_share * scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.vstack([logp, np.full((1, slots), -np.log(seen))]).astype(np.float32), written)


def _bare(w: Words) -> np.ndarray:
    """Words of ASCII digits alone."""
    digits = np.concatenate([[0], np.cumsum((w.low >= 48) & (w.low <= 57))])
    return digits[w.ends] - digits[w.starts] == w.ends - w.starts


def word_scores(m: Model, w: Words, off: np.ndarray) -> np.ndarray:
    """[words, states] scores; a state that the script rules out gets -1e4.

    A default language gets half of what ``und`` gets, and those that come
    second a little less.  Words of digits alone score 0 everywhere: they
    follow their neighbours.
    """
    n = len(w.starts)
    out = np.full((n, len(m.states)), -1e4, np.float32)
    if not n:
        return out
    slot, heads = _trigrams(w, off)
    script = _script(w.buf, w.starts)
    und = np.add.reduceat(m.logp[-1][slot], heads)
    out[:, -1] = und
    present = np.flatnonzero(np.bincount(script, minlength=N_SCRIPTS))
    for j in range(len(m.langs)):
        here = [q for q in present if m.written[j, q]]
        if here:
            s = np.add.reduceat(m.logp[j][slot], heads)
            ok = np.isin(script, here)
            out[ok, j] = s[ok]
    for q in present:
        for rank, state in enumerate(m.by_default.get(int(q), ())):
            on = script == q
            out[on, state] = und[on] * (0.5 + 0.02 * rank)
    out[_bare(w)] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each word; all texts of a piece advance together.

    Ties go to staying, then to the lower state.
    """
    n_states = scores.shape[1]
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    path = np.zeros(len(scores), np.int8)
    if not steps:
        return path
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    jumped = np.zeros((len(scores), n_states), bool)
    came = np.zeros(len(scores), np.int8)
    v = scores[start[: alive[0]]].copy()
    last = np.zeros(len(size), np.int8)
    for t in range(1, steps + 1):
        n = alive[t] if t < steps else 0
        if n < len(v):
            last[n : len(v)] = np.argmax(v[n:], axis=1)
            v = v[:n]
        if not n:
            break
        at = start[:n] + t
        top = np.argmax(v, axis=1)
        jump = v[np.arange(n), top][:, None] - np.float32(switch)
        came[at] = top
        jumped[at] = jump > v
        v = np.maximum(v, jump) + scores[at]
        v -= v.max(axis=1, keepdims=True)
    now = last.copy()
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = start[:n] + t
        path[at] = now[:n]
        if t:
            moved = jumped[at, now[:n]]
            now[:n] = np.where(moved, came[at], now[:n])
    return path


_OUT_TYPE = "lang string, share double, spans array<struct<start:int,stop:int,lang:string>>"


def label(batches, model: Model, switch: float, text_col: str = "text"):
    """(lang, share, spans, batch) of batches by their column ``text_col``.

    ``spans`` are character offsets of runs of one language, the first from 0
    and the last to the end; ``lang`` has most words, ``share`` their share.
    """
    names = np.array(model.states, object)
    for batch in batches:
        col = batch.column(text_col)
        langs, shares, spans = [], [], []
        _, all_off, _ = text_views(col)
        for lo, hi in pieces(all_off, GROUP):
            cols, scores, docs, starts, lengths = set(), [], [], [], []
            for a, b, off, w in _doc_pieces(col.slice(lo, hi - lo), 1 << 20):
                full = word_scores(model, w, off)
                # states that no word of the piece can be in take no part
                on = np.flatnonzero((full > -1e4).any(axis=0)) if len(full) else np.zeros(0, np.int64)
                cols.update(on.tolist())
                scores.append((on, np.ascontiguousarray(full[:, on])))
                chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
                base = chars[off]
                docs.append(w.doc + a)
                starts.append(chars[w.starts] - base[w.doc])
                lengths.append(np.diff(base))
            used = np.array(sorted(cols), np.int64)
            doc, start, length = np.concatenate(docs), np.concatenate(starts), np.concatenate(lengths)
            n_docs = hi - lo
            table = np.full((len(doc), max(1, len(used))), -1e4, np.float32)
            at = 0
            for on, part in scores:
                table[at : at + len(part), np.searchsorted(used, on)] = part
                at += len(part)
            path = viterbi(table, np.searchsorted(doc, np.arange(n_docs + 1)), switch)
            path = used[path] if len(used) else path
            counts = np.bincount(doc * len(names) + path, minlength=n_docs * len(names)).reshape(n_docs, -1)
            total = counts.sum(axis=1)
            best = np.where(total > 0, np.argmax(counts, axis=1), len(names) - 1)
            langs += names[best].tolist()
            shares += np.where(total > 0, counts[np.arange(n_docs), best] / np.maximum(total, 1), 0.0).tolist()
            change = np.ones(len(path), bool)
            change[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            heads = np.flatnonzero(change)
            d, begin = doc[heads], start[heads]
            opening = np.ones(len(heads), bool)
            opening[1:] = d[1:] != d[:-1]
            begin[opening] = 0
            end = np.empty(len(heads), np.int64)
            end[:-1] = begin[1:]
            closing = np.ones(len(heads), bool)
            closing[:-1] = d[1:] != d[:-1]
            end[closing] = length[d[closing]]
            row = np.searchsorted(d, np.arange(n_docs + 1))
            spans.append((row, begin, end, names[path[heads]]))
        offsets, shift = [np.zeros(1, np.int64)], 0
        for row, begin, *_ in spans:
            offsets.append(row[1:] + shift)
            shift += len(begin)
        cat = lambda i, t: pa.array(np.concatenate([s[i] for s in spans]) if spans else [], t)
        inner = pa.StructArray.from_arrays([cat(1, pa.int32()), cat(2, pa.int32()), cat(3, pa.string())], names=["start", "stop", "lang"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), inner)
        yield langs, shares, lists, batch


def languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    labelled: DataFrame | None = None,
    switch: float = SWITCH,
) -> DataFrame:
    """``(doc_id, lang, share, spans)`` for every row of ``docs``.

    Learns from ``labelled`` (default ``docs``), columns ``text_col`` and
    ``lang_col``; rows with a null in either teach nothing.  A null or empty
    text, and one without words, is ``und`` with share 0 and no spans; a null
    id stays null; repeated rows are each labelled; ties go to the language
    that comes first by name.  With nothing to learn from, Latin text is
    ``und``, and other scripts have their languages by default.  An empty
    table gives an empty one.  Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled if labelled is not None else docs, text_col, lang_col))

    def run(batches):
        for langs, shares, lists, batch in label(batches, model.value, switch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), lists], names=["doc_id", "lang", "share", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, " + _OUT_TYPE)


def labelled_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", name: str = "found", switch: float = SWITCH) -> DataFrame:
    """``docs``, each row as it is, with its language in a new column ``name``
    (underscores are put before it while a column has that name)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, lang_col))
    name = free_name(docs, name)

    def run(batches):
        for langs, _, _, batch in label(batches, model.value, switch, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, StringType())]))


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in a language that is known, with their spans."""
    return languages(documents(spark, sf_dir)).where(F.col("lang") != UND)


QUERIES = {"op6_language_spans": op6_language_spans}
