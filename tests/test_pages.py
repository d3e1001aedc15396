"""Extraction and rewriting on the original fixture site and on tricky
markup; tokenizer losslessness; entry contract."""
import os

from pyspark.sql import functions as F

from mirrorframe.functions import html as H
from mirrorframe.operators import extract as X
from mirrorframe.operators.rewrite import rewrite_pages

INDEX = """<!DOCTYPE html>
<html>
<head>
    <title>Test Site</title>
    <link rel="stylesheet" href="style.css">
</head>
<body>
    <h1>Welcome</h1>
    <p>This is the index page.</p>
    <img src="image.jpg" alt="Test Image">
    <a href="page2.html">Go to Page 2</a>
</body>
</html>"""


def test_tokenizer_lossless(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tricky = spark.createDataFrame([(1, "<a title='x > y' href=\"/q\">t</a><!-- <a href=/no> --><script>"
                                        "var s='<a href=/no>';</script>a < b <p")], "page_id long, html string")
    for df in (pages, tricky):
        assert df.where(F.array_join(H.tokenize_html("html"), "") != F.col("html")).count() == 0
    links = X.extract_links(tricky.withColumn("url", F.lit("http://h.com/")))
    assert [r.abs_url for r in links.collect()] == ["http://h.com/q"]


def test_fixture_site_extraction_and_rewrite(spark):
    pages = spark.createDataFrame([(1, "http://127.0.0.1:8000/index.html", INDEX)],
                                  "page_id long, url string, html string")
    assets = X.extract_assets(pages).orderBy("tag_rank", "tag_pos").collect()
    assert [(a.tag, a.abs_url, a.local_path, a.content_type) for a in assets] == [
        ("img", "http://127.0.0.1:8000/image.jpg", "image.jpg", None),
        ("link", "http://127.0.0.1:8000/style.css", "style.css", "text/css")]
    fetched = spark.createDataFrame([("http://127.0.0.1:8000/style.css",)], "abs_url string")  # image missing
    html = rewrite_pages(pages, fetched).first().html
    assert '<link rel="stylesheet" href="style.css">' in html
    assert '<img src="image.jpg" alt="Test Image">' in html  # not fetched: unchanged
    assert '<a href="page2.html">' in html
    assert html.replace('href="page2.html"', 'href="page2.html"') == INDEX  # nothing else changed


def test_srcset_sri_meta_refresh(spark):
    html = ('<img srcset="a.jpg 1x, data:x 2x, /b.jpg 3x" data-srcset="c.jpg 1x, d.jpg 2x">'
            '<link rel="icon" href="/f.ico" crossorigin="anonymous"><link rel="canonical" href="/c">'
            '<script src="/s.js" integrity="sha-1"></script>'
            '<meta http-equiv="REFRESH" content="0;URL=\'/news/sports\'">')
    pages = spark.createDataFrame([(1, "https://h.com/d/p.html", html)], "page_id long, url string, html string")
    a = X.extract_assets(pages).orderBy("tag_rank", "tag_pos", "attr_rank", "srcset_idx").collect()
    assert [x.abs_url for x in a] == ["https://h.com/d/a.jpg", "https://h.com/b.jpg", "https://h.com/d/c.jpg",
                                      "https://h.com/d/d.jpg", "https://h.com/s.js", "https://h.com/f.ico"]
    assert [x.content_type for x in a if x.tag == "link"] == ["image/x-icon"]
    m = X.extract_meta_refresh(pages).first()
    assert m.norm_url == "https://h.com/news/sports"  # whole path kept (letter s included)
    fetched = spark.createDataFrame([("https://h.com/s.js",), ("https://h.com/f.ico",)], "abs_url string")
    out = rewrite_pages(pages, fetched).first().html
    assert 'srcset="d/a.jpg 1x, data:x 2x, b.jpg 3x"' in out
    assert '<script src="s.js"></script>' in out
    assert '<link rel="icon" href="f.ico">' in out
    assert '<link rel="canonical" href="/c">' in out


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    no_sql = set(E.queries()) - set(E.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in no_sql)


def test_odd_markup(spark):
    rows = [(1, "<a title=it's href=/x>t</a><a href=/y>y</a><p>it's</p>"),
            (2, '<title><a href="/no"></title><textarea><a href=/no2></textarea><a href="/yes?p=1&#038;q=&eacute;">y</a>'),
            (3, '<a href="tel:+123">x</a><a href="ftp://h.com/f">f</a><script>open <a href=/n>')]
    pages = spark.createDataFrame([(i, "http://h.com/", h) for i, h in rows], "page_id long, url string, html string")
    assert pages.where(F.array_join(H.tokenize_html("html"), "") != F.col("html")).count() == 0
    got = sorted((r.page_id, r.abs_url) for r in X.extract_links(pages, follow_domains=True).collect())
    assert got == [(1, "http://h.com/x"), (1, "http://h.com/y"), (2, "http://h.com/yes?p=1&q=\u00e9")]


def test_character_references_like_the_standard_library(spark):
    import html
    cases = ["a&amp;b", "&copy;&eacute;&#x27;&#39;", "&#0;&#x110000;&#150;&#xD800;", "&bogus;", "x&copy", "&", "&#", "&#x1F600;", "&notin;"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s string").orderBy("i").select(
        H.unescape("s")).collect()
    assert [g[0] for g in got] == [html.unescape(c) for c in cases]


def test_corpus_keeps_the_first_copy(spark):
    pages = spark.createDataFrame([(5, "http://a.com/x/", "five"), (2, "http://a.com/x#f", "two"), (3, "http://a.com/y", "y")],
                                  "page_id long, url string, html string")
    assert sorted((r.norm_url, r.page_id, r.html) for r in X.corpus(pages).collect()) == [
        ("http://a.com/x", 2, "two"), ("http://a.com/y", 3, "y")]
