"""Every operator over odd rows and over an empty table."""

import pytest
from pyspark.sql import functions as F

from pagemill.llm import bpe, chroma, decontaminate, huffman, langid, lm, pii, quality, simhash, suffix


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "x"), (None, "a b c d e f g h i", "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x")], "item_id long, text string, h string")


def labels(spark, docs):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "suffix": lambda s, d: suffix.repeated_passages(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, bench(s)),
    "decontaminate_shuffled": lambda s, d: decontaminate.contamination(d, bench(s), broadcast_bytes=0),
    "chroma": lambda s, d: chroma.aligned(d, media_col="text", decoder=chroma.melody),
    "bpe": lambda s, d: bpe.encode(d),
    "pii": lambda s, d: pii.redact(d),
    "langid": lambda s, d: langid.languages(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "lm": lambda s, d: lm.score(d),
    "quality": lambda s, d: quality.classify(d, labels(s, d)),
    "huffman": lambda s, d: huffman.compress(huffman.tokenise(d), 50256, "uint16")[0],
}
EACH_ROW = ("bpe", "pii", "langid", "lm", "quality", "huffman")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, no_docs, name):
    assert OPERATORS[name](spark, no_docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd_docs, name):
    rows = OPERATORS[name](spark, odd_docs).collect()
    if name in EACH_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
        null = [r for r in rows if r.doc_id == 2]
        assert len(null) == 1
    else:
        assert all(r[0] is not None for r in rows)


def test_ties_and_repeats(spark, odd_docs):
    pairs = {tuple(r) for r in simhash.near_duplicates(odd_docs).collect()}
    assert pairs == {(4, 1), (6, 3), (8, 3)}
    spans = {(r.doc_id, r.start, r.stop, r.first_doc_id) for r in suffix.repeated_passages(odd_docs).collect()}
    assert spans == {(1, 0, 120, 1), (4, 0, 120, 1)}
    found = {(r.rec_id, r.match_id, r.offset) for r in chroma.aligned(odd_docs, media_col="text", decoder=chroma.melody).collect()}
    assert (4, 1, 0) in found and all(a > b for a, b, _ in found)


def test_null_results(spark, odd_docs):
    one = lambda df: df.where("doc_id = 2").first()
    assert one(bpe.encode(odd_docs)).ids is None
    assert one(lm.score(odd_docs)).log_prob is None
    r = one(langid.languages(odd_docs))
    assert (r.lang, r.share, r.spans) == ("und", 0.0, [])
    assert one(pii.redact(odd_docs)).text is None
    assert one(quality.classify(odd_docs, labels(spark, odd_docs))).keep is None
    assert one(OPERATORS["huffman"](spark, odd_docs)).data is None
    empty = lm.score(odd_docs).where("doc_id = 3").first()
    assert (empty.n_bytes, empty.log_prob, empty.bits_per_byte) == (0, 0.0, None)


def test_rows_keep_their_columns(spark, odd_docs):
    kept = pii.redacted_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    named = langid.labelled_rows(odd_docs)
    assert named.columns == [*odd_docs.columns, "_found"]
    assert named.where(F.col("_found") == "und").count() >= 4


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bench")
    bench(spark).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "decontamination", "pii_redaction", "bpe_encoding"])
def test_stages_over_an_empty_table(spark, no_docs, bench_dir, name):
    out = stages()[name](spark, no_docs, bench_dir)
    assert out.collect() == [] and (name == "bpe_encoding" or out.columns == no_docs.columns)


def test_stages_over_odd_rows(spark, odd_docs, bench_dir):
    key = lambda rows: sorted((str(r.doc_id), str(r.text)[:20]) for r in rows)
    every = odd_docs.collect()
    run = lambda name: stages()[name](spark, odd_docs, bench_dir)
    found = run("language_id")
    assert found.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(["1", "None", "4", "4", "5", "7", "9", "10"])
    kept = run("near_dedup")
    assert kept.columns == odd_docs.columns and key(kept.collect()) == key(r for r in every if r.doc_id not in (4, 6, 8))
    clean = run("decontamination")
    assert clean.columns == odd_docs.columns and key(clean.collect()) == key(every)
    red = run("pii_redaction")
    assert red.columns == odd_docs.columns
    by = {r.doc_id: r for r in red.collect()}
    assert (by[2].text, by[2].n_chars, by[3].text, by[3].n_chars) == (None, None, "", 0) and "[EMAIL]" in by[10].text and red.count() == len(every)
    ids = {r.doc_id: r for r in run("bpe_encoding").collect()}
    assert ids[2].ids is None and ids[3].ids == [] and ids[5].exact


def test_stored_tables_are_cleared(spark, odd_docs):
    import os

    from pagemill.llm import common

    table = common.stored(odd_docs, "test")
    path = table._stored_path.removeprefix("file://").removeprefix("file:")
    assert table.count() == odd_docs.count() and os.path.exists(path)
    common.clear_stored()
    assert not os.path.exists(path) and not common._STORED
