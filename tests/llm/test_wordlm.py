"""Word n-gram scores against plain counting."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import wordlm


def plain(texts):
    """Counts of the n-grams of each order, and each text's padded words."""
    padded = [["<s>", "<s>", *t.lower().split(), "</s>"] if t else [] for t in texts]
    n = [Counter(tuple(x[i - k : i + 1]) for x in padded for i in range(2, len(x))) for k in (2, 1, 0)]
    return n, padded


def test_scores_equal_plain_word_interpolation(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["abc", "abd", "b", "Ca", "é1", "x7", "x8"]) for _ in range(r.randint(0, 40)))) for k in range(80)]
    monkeypatch.setattr(wordlm, "RANGE_KEYS", 256)
    seen = []
    keep = wordlm.weights
    monkeypatch.setattr(wordlm, "weights", lambda held, *a: seen.append(keep(held, *a)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in wordlm.score(df).collect()}
    lam = seen[0]
    n, padded = plain([t for _, t in rows])
    docs, events, words = sum(map(bool, padded)), sum(n[2].values()), len(n[2])
    after = lambda g, table: docs if g[-1] == "<s>" else table[g]
    for (d, _), x in zip(rows, padded):
        want = 0.0
        for i in range(2, len(x)):
            c = after((x[i - 1],), n[2])
            context = tuple(x[i - 2 : i])
            c3 = docs if context[-1] == "<s>" else n[1][context]
            p = [n[0][tuple(x[i - 2 : i + 1])] / c3, n[1][tuple(x[i - 1 : i + 1])] / c, n[2][(x[i],)] / events, 1 / (words + 1)]
            want += np.log(np.dot(lam[int(np.ceil(np.log2(c3 + 1)))], p))
        assert abs(got[d].log_prob - want) < 1e-6 * max(1, abs(want))


def test_weights_fit_the_held_out_events():
    r = np.random.default_rng(0)
    b, p = r.integers(0, 5, 4000), r.random((4000, 4)) * [1, 0.2, 0.05, 0.001]
    lam, fits = np.full((wordlm.BUCKETS, 4), 0.25), []
    for _ in range(5):
        total, fit = wordlm.shares(lam, b, p)
        fits.append(fit)
        lam = np.where(total.sum(axis=1, keepdims=True) > 0, total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), lam)
    assert fits == sorted(fits) and fits[-1] > fits[0]


def test_digits_and_letters_are_told_apart(spark):
    """64 classes of bytes could not tell these apart."""
    rows = [(k, "the code is 4711 today") for k in range(200)] + [(1000, "the code is 4711 today"), (1001, "the code is 4811 today")]
    got = {x.doc_id: x.log_prob for x in wordlm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001] < got[1000] - 1


def test_counts_grow_with_the_corpus(spark, tmp_path):
    def entries(n):
        r = random.Random(n)
        rows = [(k, " ".join(f"w{r.randrange(100000)}" for _ in range(100))) for k in range(n)]
        df = spark.createDataFrame(rows, "id long, text string").withColumn("role", F.lit(0))
        sent = df.mapInArrow(lambda it: wordlm._chunks(it, 0), wordlm._CHUNK).mapInArrow(lambda it: wordlm._send(it, 4), "bucket int, chunk long, role int, keys binary, n binary")
        return len(set(np.concatenate([np.cumsum(wordlm._unplanes(x.keys)) for x in sent.select("keys").collect()]).tolist()))

    assert entries(400) > 7 * entries(50)


def test_odd_rows_and_other_corpus(spark, odd_docs, no_docs):
    want = sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    for corpus in (None, odd_docs, no_docs):
        got = wordlm.score(odd_docs, corpus=corpus).collect()
        assert sorted(str(r.doc_id) for r in got) == want
        by = {r.doc_id: r for r in got}
        assert by[2].log_prob is None and by[2].n_bytes is None
        assert (by[3].n_bytes, by[3].log_prob, by[3].bits_per_byte) == (0, 0, None)
        assert all(np.isfinite(r.log_prob) for r in got if r.log_prob is not None)
    assert wordlm.score(no_docs).collect() == []
