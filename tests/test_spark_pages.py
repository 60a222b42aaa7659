"""Page operators on DataFrames: guards, clashes, streams, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions.register import register
from pagemill.operators import pages as P
from pagemill.operators import trees
from pagemill.operators.tfidf import tfidf
from pagemill.sources import pages as src
from pagemill.streaming.pages import clean_stream, page_stream

HTML = "<html><head><title>T</title></head><body><article><p>" + "Some words of text. " * 20 + "</p></article><script>x</script></body></html>"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, "https://x.org/a", HTML, "k"), (2, None, None, "k"), (3, "u", "", None), (4, "u", "x" * 5000, "k"), (1, "https://x.org/a", HTML, "k")], "page_id long, url string, html string, metadata string")


def test_guards_and_clashing_names(odd):
    out = P.clean_pages(odd, max_input_bytes=4000)
    assert out.columns == ["page_id", "url", "html", "metadata", "_html", "messages", "_metadata", "page_type", "confidence", "error"]
    got = {r.page_id: r for r in out.collect()}
    assert got[2].error == "html must be a string" and got[4].error == "input exceeds 4000 bytes" and got[4]._html is None
    assert got[1].error is None and got[1]["_metadata"].title == "T" and got[3]["_html"] == "" and got[3].error is None
    with pytest.raises(Exception, match="input exceeds|must be a string"):
        P.clean_pages(odd, max_input_bytes=4000, mode="FAILFAST").collect()


def test_empty_table(odd):
    for op in (P.clean_pages, P.extract_pages, P.page_metadata, P.page_signals, P.page_features, P.page_nodes):
        assert op(odd.limit(0)).collect() == []


def test_options(odd):
    keep = {r.page_id: r for r in P.clean_pages(odd, boilerplate="keep").collect()}
    assert keep[1].page_type is None and keep[1]["_html"].startswith("<!DOCTYPE html>")
    assert P.extract_pages(odd, page_type="forum").first().page_type == "forum"
    for bad in ({"boilerplate": "strict"}, {"page_type": "x"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            P.clean_pages(odd, **bad)
    with pytest.raises(TypeError):
        P.clean_pages(odd, include_links=1)


def test_json_round_trip(odd):
    c = P.clean_pages(odd.drop("metadata").withColumnRenamed("html", "source"), html_col="source")
    rows = c.select("html", P.result_json(c).alias("j")).select("html", "j", P.parse_result(F.col("j")).alias("p")).where("html is not null").collect()
    for r in rows:
        assert r.p.html == r.html and "error" not in json.loads(r.j)


def test_stream_equals_batch(spark, odd, tmp_path):
    odd.select("page_id", "url", "html").write.parquet(str(tmp_path / "in"))
    q = clean_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = P.clean_pages(odd.select("page_id", "url", "html"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bytes(spark):
    rows = [(1, "é".encode()), (2, b"\xef\xbb\xbfa"), (3, "é".encode("utf-16")), (4, b"\xfe\xff" + "z".encode("utf-16-be")), (5, b""), (6, "Ça déjà vu, où être naïf à Noël".encode("latin-1")), (7, None), (8, b"\xff\xfe\0\0" + "q".encode("utf-32-le"))]
    got = {r.k: r for r in src.decoded(spark.createDataFrame(rows, "k int, content binary"), "content").collect()}
    assert [got[k].html for k in (1, 2, 3, 4, 5, 7, 8)] == ["é", "a", "é", "z", "", None, "q"]
    assert got[6].html is not None or got[6].messages[0].type == "error"


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.html").write_text(HTML)
    df = src.html_files(spark, str(tmp_path / "a.html"))
    assert df.first().html == HTML and src.byte_files(spark, str(tmp_path / "a.html")).first().html == HTML
    c = P.clean_pages(df.withColumnRenamed("html", "raw"), html_col="raw", url_col=None)
    src.write_json(c, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value)["metadata"]["title"] == "T"
    src.write_html(c, str(tmp_path / "h"))
    assert "Some words" in spark.read.text(str(tmp_path / "h"), wholetext=True).first().value


def test_tree_operators(spark):
    rows = spark.createDataFrame([(1, "<div class=c><p>a<b>b</b></p></div><p>c</p><meta name=k content=1><meta name=k content=2>"), (2, None), (3, "")], "page_id long, html string")
    nodes = P.node_table(rows)
    text = {(r.page_id, r.text) for r in trees.text_of(nodes.where("tag = 'p'"), nodes).collect()}
    assert text == {(1, "ab"), (1, "c")}
    assert trees.without(nodes, nodes.where("tag = 'div'")).where("page_id = 1 and tag = 'p'").count() == 1
    assert [tuple(r) for r in trees.meta_map(nodes).collect()] == [(1, "k", "1")]
    assert nodes.where("tag = 'div'").select(T.hidden(F.col("attrs")).alias("h")).first().h is False


def test_levels_have_no_limit_of_rows_or_depth(spark):
    """A recursive query ended at spark.sql.cteRecursionRowLimit rows of all pages, and at 100 levels."""
    nodes = P.node_table(spark.createDataFrame([(1, "<div>" * 150 + "x"), (2, "<p>a<b>b</b></p>")], "page_id long, html string"))
    nodes = nodes.select("page_id", "nid", "pid").union(spark.createDataFrame([(2, 99, 98), (3, 0, -1), (3, 5, 7), (3, 7, 0)], "page_id long, nid int, pid int"))
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        got = {(r.page_id, r.nid): r.level for r in trees.levels(nodes).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert [got[1, k] for k in (0, 3, 4, 153, 154)] == [0, 2, 3, 152, 153] and (2, 99) not in got
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, 0): 0, (3, 7): 1, (3, 5): 2}


def test_tfidf(spark):
    df = spark.createDataFrame([(1, "best news of 2024"), (2, "zzz"), (3, None)], "k long, t string")
    got = tfidf(df, "k", F.col("t")).collect()
    assert {r.term for r in got} == {"best", "news", "of", "2024"} and abs(sum(r.weight**2 for r in got) - 1) < 1e-9


def test_sql_functions(spark, odd):
    register(spark)
    odd.createOrReplaceTempView("odd_pages")
    r = spark.sql("select page_title(html) t, page_text_length(html) n, clean_html(html) h, page_type(html, url) p, page_content(html, url) c from odd_pages where page_id = 1").first()
    assert r.t == "T" and r.n > 200 and "script" not in r.h and r.p == "article" and r.c.startswith("<article>")


def test_native_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.collapse(F.lit(" a  b "))) == "a b" and one(T.unescape_named(F.lit("&amp;lt;"))) == "&lt;" and one(T.escape(F.lit("<&>"))) == "&lt;&amp;&gt;"
    assert one(T.check_authors(F.lit("A B; c d"), ["C D"])) == "A B" and one(T.page_type_alias(F.lit("Docs"))) == "documentation" and one(T.page_type_alias(F.lit("x"))) is None
    a, b = T.title_parts(F.lit("Story - Site.com"))
    assert (one(a), one(b)) == ("Story", "Site.com")


def test_config_file(tmp_path):
    f = tmp_path / "c.json"
    for text, match in (("{", "not valid JSON"), ('{"x": 1}', "unknown field")):
        f.write_text(text)
        with pytest.raises(ValueError, match=match):
            P.load_config(str(f))
    with pytest.raises(ValueError, match="cannot read"):
        P.load_config(str(tmp_path / "none"))
    f.write_text('{"allowedTags": ["p"]}')
    assert P.load_config(str(f)) == {"allowedTags": ["p"]}
