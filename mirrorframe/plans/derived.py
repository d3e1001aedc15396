"""Input builders for operators whose inputs the driver tables lack.

They only produce rows in the schema an operator expects (extra markup on
the real pages, a link-graph site, robots files, sitemap documents, HTTP
responses, job events); every step the query names then runs on them
through the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import scratch_path

SITE = "https://site.example.com"


def _s(c) -> F.Column:
    return F.col(c).cast("string")


def asset_markup(pages: DataFrame) -> DataFrame:
    """pages with an image (+srcset), a stylesheet link with SRI, a script and
    a second ``<style>`` block using ``url()`` and ``@import`` appended."""
    pid = F.col("page_id")
    extra = F.concat(
        F.lit('<img src="/img/'), (pid % 7).cast("string"), F.lit('.png" srcset="/s/'), _s("page_id"),
        F.lit('.jpg 1x, /l/'), _s("page_id"), F.lit('.jpg 2x">'),
        F.lit('<link rel="stylesheet" href="/css/'), (pid % 3).cast("string"), F.lit('.css" integrity="x">'),
        F.lit('<script src="/js/'), (pid % 5).cast("string"), F.lit('"></script>'),
        F.lit("<style>body{background:url(/bg/"), (pid % 4).cast("string"), F.lit(".png)} @import \"x"),
        (pid % 2).cast("string"), F.lit('.css"; i{background:url(data:x)}</style>'))
    refresh = F.when(pid % 10 == 0, F.concat(F.lit('<meta http-equiv="Refresh" content="0; url=/news/'),
                                             _s("page_id"), F.lit('">'))).otherwise(F.lit(""))
    return pages.select("page_id", "url", F.concat("html", refresh, extra).alias("html"))


def asset_responses(pages: DataFrame) -> DataFrame:
    """``fetched(abs_url)``: the files each host serves for the markup of
    ``asset_markup`` — images, srcset files, stylesheets and CSS backgrounds;
    scripts (``/js/…``) are missing."""
    origin = F.concat(U.url_parts("url")["scheme"], F.lit("://"), U.authority("url"))
    pid = F.col("page_id")
    files = F.array(
        F.concat(origin, F.lit("/img/"), (pid % 7).cast("string"), F.lit(".png")),
        F.concat(origin, F.lit("/s/"), _s("page_id"), F.lit(".jpg")),
        F.concat(origin, F.lit("/l/"), _s("page_id"), F.lit(".jpg")),
        F.concat(origin, F.lit("/css/"), (pid % 3).cast("string"), F.lit(".css")),
        F.concat(origin, F.lit("/bg/"), (pid % 4).cast("string"), F.lit(".png")))
    return pages.select(F.explode(files).alias("abs_url")).distinct()


def link_graph_site(pages: DataFrame) -> DataFrame:
    """A one-host site over the page ids: page i links to 2i+1, 2i+2 and back
    to the home page; every tenth page also has a meta refresh to a missing
    news page.  ``(page_id, url, html)``."""
    pid = F.col("page_id")
    html = F.concat(
        F.lit("<html><head><title>p"), _s("page_id"), F.lit("</title>"),
        F.when(pid % 10 == 0, F.concat(F.lit('<meta http-equiv="refresh" content="0; url=/news/'),
                                       _s("page_id"), F.lit('">'))).otherwise(F.lit("")),
        F.lit('</head><body><a href="/p/'), (pid * 2 + 1).cast("string"), F.lit('">left</a> <a href="/p/'),
        (pid * 2 + 2).cast("string"), F.lit('">right</a> <a href="/p/0#top">home</a></body></html>'))
    return pages.select("page_id", F.concat(F.lit(SITE + "/p/"), _s("page_id")).alias("url"),
                        html.alias("html"))


def site_robots() -> tuple[str, int, str]:
    return ("site.example.com", 200, "User-agent: *\nDisallow: /p/7\n")


def host_robots(pages: DataFrame) -> DataFrame:
    """One robots.txt per host of the corpus: ``(host, status, body)``.
    Hosts whose name starts with 'blog.' answer 403, 'm.' 404 and 'www.' 503;
    the others serve a file with a decoy group, a ``*`` group that disallows
    the first letter of the host and an empty ``Disallow`` group."""
    hosts = pages.select(U.authority("url").alias("host")).distinct()
    first = F.substring(F.regexp_replace("host", r"^(blog|m|www)\.", ""), 1, 1)
    body = F.concat(
        F.lit("# robots for "), F.col("host"), F.lit("\nUser-agent: other-bot\nDisallow: /\n\n"),
        F.lit("User-agent: *\nAllow: /"), first, F.lit("x\nDisallow: /"), first,
        F.lit("  # letters\nDisallow: /a\n\nUser-agent: *\nDisallow: /\n"))
    status = (F.when(F.col("host").startswith("blog."), 403).when(F.col("host").startswith("m."), 404)
              .when(F.col("host").startswith("www."), 503).otherwise(200))
    return hosts.select("host", status.alias("status"), body.alias("body"))


def sitemap_docs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page an index ``/sitemap-{id}.xml`` pointing at two child sitemaps;
    child ``a`` lists the page URL, child ``b`` (only for even ids) lists two
    paths; odd ids' child ``b`` answers 404.  Returns ``(roots, sitemaps)``
    with ``roots(crawl_id, url)`` and ``sitemaps(url, status, content_type, body)``."""
    host = F.concat(U.url_parts("url")["scheme"], F.lit("://"), U.authority("url"))
    base = pages.select("page_id", "url", host.alias("origin"))
    idx = F.concat(F.col("origin"), F.lit("/sitemap-"), _s("page_id"), F.lit(".xml"))
    child_a = F.concat(F.col("origin"), F.lit("/sm-"), _s("page_id"), F.lit("-a.xml"))
    child_b = F.concat(F.col("origin"), F.lit("/sm-"), _s("page_id"), F.lit("-b.xml"))
    index_doc = F.concat(
        F.lit('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
        F.lit("<sitemap><loc> "), child_a, F.lit(" </loc></sitemap><sitemap><loc>"), child_b,
        F.lit("</loc></sitemap><url><loc>"), F.col("origin"), F.lit("/ignored</loc></url></sitemapindex>"))
    a_doc = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'),
                     F.col("url"), F.lit("</loc></url><url><loc>  </loc></url></urlset>"))
    b_doc = F.concat(F.lit("<urlset><url><loc>"), F.col("origin"), F.lit("/x/"), _s("page_id"),
                     F.lit("</loc><lastmod>2024</lastmod></url><url><loc>\n"), F.col("origin"), F.lit("/y/"),
                     _s("page_id"), F.lit("\n</loc></url></urlset>"))
    even = F.col("page_id") % 2 == 0
    docs = base.select(F.explode(F.array(
        F.struct(idx.alias("url"), F.lit(200).alias("status"), F.lit("application/xml").alias("content_type"),
                 index_doc.alias("body")),
        F.struct(child_a.alias("url"), F.lit(200).alias("status"),
                 F.lit("text/xml; charset=utf-8").alias("content_type"), a_doc.alias("body")),
        F.struct(child_b.alias("url"), F.when(even, 200).otherwise(404).alias("status"),
                 F.lit("application/xml").alias("content_type"), b_doc.alias("body")))).alias("d")
    ).select("d.*")
    roots = base.select(_s("page_id").alias("crawl_id"), idx.alias("url"))
    return roots, docs


def event_responses(events: DataFrame) -> DataFrame:
    """HTTP responses from events: one URL per user, one attempt per event.
    error -> 429 (even ids, with a Retry-After) or 500; view -> 200 html;
    click -> 304; other -> 404."""
    et = F.col("event_type")
    status = (F.when(et == "error", F.when(F.col("event_id") % 2 == 0, 429).otherwise(500))
              .when(et == "view", 200).when(et == "click", 304).otherwise(404))
    retry_after = F.when((et == "error") & (F.col("event_id") % 2 == 0), F.when(
        F.col("event_id") % 4 == 0, F.floor("value").cast("string")).otherwise(
        F.date_format(F.col("ts") + F.make_interval(secs=F.floor("value")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")))
    ctype = (F.when(et == "view", F.lit("text/html; charset=utf-8"))
             .when(et == "purchase", F.lit("application/json")).otherwise(F.lit("text/plain")))
    body_len = F.when(status == 200, F.floor(F.col("value") * 1000)).otherwise(F.lit(0)).cast("long")
    return events.select(
        "event_id", F.concat(F.lit("https://api.example.com/u/"), _s("user_id")).alias("url"),
        status.alias("status"), ctype.alias("content_type"), retry_after.alias("retry_after"),
        body_len.alias("size"), F.col("ts").cast("timestamp").alias("ts"))


def host_mix(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs with literal private/public IPv4 hosts, a host with a port and
    named hosts, plus a ``dns(host, ip)`` table for part of the names."""
    eid = F.col("event_id")
    k = eid % 4
    url = (F.when(k == 0, F.concat(F.lit("http://10.0."), (eid % 256).cast("string"), F.lit(".1/")))
           .when(k == 1, F.concat(F.lit("http://8.8."), (eid % 256).cast("string"), F.lit(".8/")))
           .when(k == 2, F.concat(F.lit("http://172."), (eid % 32 + 16).cast("string"), F.lit(".0.1:8080/x")))
           .otherwise(F.concat(F.lit("https://Name"), _s("event_id"), F.lit(".example.com/p"))))
    urls = events.select("event_id", url.alias("url"))
    dns = (events.where((eid % 4 == 3) & (eid % 3 != 0))
           .select(F.concat(F.lit("name"), _s("event_id"), F.lit(".example.com")).alias("host"),
                   F.when(eid % 2 == 0, F.concat(F.lit("192.168.1."), (eid % 256).cast("string")))
                   .otherwise(F.lit("93.184.216.34")).alias("ip")))
    return urls, dns


def document_snapshots(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two crawls of the documents as ``snapshot(url, etag, last_modified,
    md5)``: the second misses every tenth document, edits every seventh and
    adds new ones; a third of the URLs carry an ETag, a third Last-Modified,
    the rest only a content hash."""
    did = F.col("doc_id")
    url = F.concat(F.lit("doc://"), _s("doc_id"))

    def snap(df, text, lm):
        return df.select(url.alias("url"), F.when(did % 3 == 0, F.md5(text)).alias("etag"),
                         F.when(did % 3 == 1, lm).alias("last_modified"), F.md5(text).alias("md5"))

    old = snap(documents, F.col("text"), F.lit("v1"))
    kept = documents.where(did % 10 != 0)
    edited = F.when(did % 7 == 0, F.concat(F.col("text"), F.lit(" [edited]"))).otherwise(F.col("text"))
    new = snap(kept, edited, F.when(did % 7 == 0, F.lit("v2")).otherwise(F.lit("v1")))
    added = documents.where(did % 10 == 5).select(
        F.concat(F.lit("doc://"), (did + 100000000).cast("string")).alias("url"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.md5("text").alias("md5"))
    return old, new.unionByName(added)


def site_asset_hook(url, html):
    """An ``after_html`` hook for the link-graph site: every page also shows
    an image (one of three) and the site stylesheet."""
    pid = F.regexp_extract(url, r"/p/(\d+)$", 1).cast("long")
    return F.concat(html, F.lit('<img src="/img/'), (pid % 3).cast("string"),
                    F.lit('.png"><link rel="stylesheet" href="/css/site.css">'))


def site_responses(pages: DataFrame) -> DataFrame:
    """Asset answers of the link-graph site: the three images, the stylesheet
    (with a background image) and that image; ``(url, status, content_type,
    body, size)``."""
    spark = pages.sparkSession
    imgs = (pages.select((F.col("page_id") % 3).alias("k")).distinct()
            .select(F.concat(F.lit(SITE + "/img/"), F.col("k").cast("string"), F.lit(".png")).alias("url"),
                    F.lit(200).alias("status"), F.lit("image/png").alias("content_type"),
                    F.encode(F.concat(F.lit("PNG"), F.col("k").cast("string")), "UTF-8").alias("body")))
    other = spark.createDataFrame(
        [(SITE + "/css/site.css", 200, "text/css", bytearray(b"body{background:url(bg.png)}")),
         (SITE + "/css/bg.png", 200, "image/png", bytearray(b"BG")),
         (SITE + "/css/missing.png", 404, "text/html", bytearray(b""))],
        "url string, status int, content_type string, body binary")
    out = imgs.unionByName(other)
    return out.withColumn("size", F.octet_length("body").cast("long"))


def link_graph_sites(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pages as four sites by ``page_id % 4``, each a tree over
    ``page_id // 4`` as in ``link_graph_site``; seeds and robots rules."""
    from ..operators.robots import parse_robots

    spark = pages.sparkSession
    i = F.expr("page_id div 4")
    origin = F.concat(F.lit("https://site"), (F.col("page_id") % 4).cast("string"), F.lit(".example.com"))
    html = F.concat(F.lit('<a href="/p/'), (i * 2 + 1).cast("string"), F.lit('">l</a> <a href="/p/'), (i * 2 + 2).cast("string"),
                    F.lit('">r</a> <a href="/p/0#top">home</a>'))
    site = pages.select("page_id", F.concat(origin, F.lit("/p/"), i.cast("string")).alias("url"), html.alias("html"))
    hosts = pages.select(F.concat(F.lit("site"), (F.col("page_id") % 4).cast("string")).alias("crawl_id")).distinct()
    seeds = hosts.select("crawl_id", F.concat(F.lit("https://"), F.col("crawl_id"), F.lit(".example.com/p/0")).alias("url"))
    rules = hosts.where("crawl_id = 'site1'").select(
        F.lit("site1.example.com").alias("host"), F.lit(200).alias("status"), F.lit("User-agent: *\nDisallow: /p/7\n").alias("body"))
    return site, seeds, parse_robots(rules)


def document_runs(documents: DataFrame) -> list[DataFrame]:
    """Answers to three runs over the documents: ``(url, status, size, md5,
    etag, last_modified, ts)``."""
    docs = documents.where(F.length("text") > 0)
    did = F.col("doc_id")
    url = F.concat(F.lit("doc://"), _s("doc_id"))

    def answers(df, status, text, modified, day, tag=True):
        return df.select(
            url.alias("url"), status.alias("status"), F.octet_length(text).cast("long").alias("size"), F.md5(text).alias("md5"),
            F.when((did % 3 == 0) & F.lit(tag), F.md5(text)).alias("etag"),
            F.when((did % 3 == 1) & F.lit(tag), modified).alias("last_modified"),
            F.lit(f"2024-01-0{day} 12:00:00").cast("timestamp").alias("ts"))

    first = answers(docs, F.lit(200), F.col("text"), F.lit("v1"), 1)
    edited = (did % 7 == 0) & (did % 11 != 0) & (did % 13 != 0)
    status = (F.when(did % 13 == 0, 404).when(did % 11 == 0, 500).when(did % 7 == 0, 200).otherwise(304))
    told = F.when(edited, F.lit("v2")).when(did % 5 == 0, F.lit("v1b"))
    asked = docs.where(did % 10 != 9)
    second = answers(asked, status, F.when(edited, F.concat("text", F.lit(" [edited]"))).otherwise(F.col("text")), told, 2)
    # a 304 says no validator that it does not change
    second = second.withColumn("etag", F.when(F.col("status") != 304, F.col("etag")))
    fresh = answers(docs.where(did % 10 == 5).withColumn("doc_id", did + 100000000), F.lit(200), F.col("text"), F.lit(""), 2, False)
    third = answers(asked, F.when(did % 13 == 0, 404).otherwise(304), F.col("text"), F.lit(""), 3, False)
    return [first, second.unionByName(fresh), third]


def page_image_hook(url, html):
    """An ``after_html`` hook for the link-graph site: every page shows an image of its own."""
    return F.concat(html, F.lit('<img src="/img/'), F.regexp_extract(url, r"/p/(\d+)$", 1), F.lit('.png">'))


def image_runs(pages: DataFrame) -> list[DataFrame]:
    """Answers to two runs for the images of ``page_image_hook``: all sent;
    then, by ``page_id % 4``, unchanged, sent anew, gone, failed."""
    pid, k = _s("page_id"), F.col("page_id") % 4
    url = F.concat(F.lit(SITE + "/img/"), pid, F.lit(".png"))

    def answers(status, body, tag):
        return pages.select(url.alias("url"), status.alias("status"), F.lit("image/png").alias("content_type"),
                            F.encode(body, "UTF-8").alias("body"), tag.alias("etag"), F.lit(None).cast("string").alias(
                                "last_modified")).withColumn("size", F.octet_length("body").cast("long"))

    first = answers(F.lit(200), F.concat(F.lit("PNG"), pid), F.concat(F.lit("e"), pid))
    status = F.element_at(F.array(*map(F.lit, [304, 200, 404, 503])), (k + 1).cast("int"))
    second = answers(status, F.when(k == 1, F.concat(F.lit("NEW"), pid)).otherwise(F.lit("")),
                     F.when(k == 1, F.concat(F.lit("f"), pid)))
    return [first, second]


def importing_sheets(pages: DataFrame) -> DataFrame:
    """One stylesheet per page id, ``(page_id, url, css)``: it imports three
    others by number, itself among them, so that imports run in circles."""
    n = pages.agg(F.count("*").alias("n"))
    i, other = F.col("page_id"), lambda x: F.concat(F.lit('@import "'), x.cast("string"), F.lit('.css";\n'))
    css = F.concat(other((i * 2 + 1) % F.col("n")), other(i), other((i * i + 3) % F.col("n")),
                   F.lit("body{background:url(bg"), (i % 5).cast("string"), F.lit(".png)}"))
    return pages.select("page_id").crossJoin(F.broadcast(n)).select(
        "page_id", F.concat(F.lit(SITE + "/css/"), _s("page_id"), F.lit(".css")).alias("url"), css.alias("css"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, ts, part)``: a page a minute, every ninth dated
    twelve hours earlier; each links to its two children, to the left one
    twice, and to the left child of the page before it.  ``part``: sixths."""
    i = F.col("page_id")
    a = lambda x: F.concat(F.lit('<a href="/p/'), x.cast("string"), F.lit('">x</a>'))
    minutes = i - F.when(i % 9 == 4, 720).otherwise(0)
    n = pages.agg(F.count("*").alias("n"))
    return pages.select("page_id").crossJoin(F.broadcast(n)).select(
        "page_id", F.concat(F.lit(SITE + "/p/"), _s("page_id")).alias("url"),
        F.concat(a(2 * i + 1), a(2 * i + 2), a(2 * i + 1), a(F.abs(2 * i - 1))).alias("html"),
        F.timestamp_seconds(F.lit(1704153600) + minutes * 60).alias("ts"), F.expr("page_id * 6 div n").alias("part"))


def as_batches(rows: DataFrame, part, name: str) -> tuple[str, object]:
    """Writes rows as files that a file stream takes one at a time, in the
    order of ``part`` (a small number); the folder and its schema."""
    spark = rows.sparkSession
    path, held = scratch_path(spark, name), scratch_path(spark, name + "-rows")
    rows.withColumn("_part", part).write.parquet(held)
    table = spark.read.parquet(held)
    for p in sorted(r[0] for r in table.select("_part").distinct().collect()):
        table.where(F.col("_part") == p).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return path, rows.schema


def refreshed_hosts(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pages, seeds, sitemap_urls)``: the given pages with a meta refresh to the ``mirror-`` host of the page with the next id; one
    crawl a host, seeded with its first page, whose sitemap lists the host's even pages and, beside each page, the next one if
    that is of another host."""
    from ..operators import extract as X
    at = X.corpus(pages).select("page_id", "norm_url", U.authority("norm_url").alias("crawl_id"))
    nxt = at.select((F.col("page_id") - 1).alias("page_id"), F.col("norm_url").alias("next_url"),
                    F.col("crawl_id").alias("next_host"))
    pairs = at.join(nxt, "page_id", "left")
    refresh = F.concat(F.lit('<meta http-equiv="refresh" content="0; url='),
                       F.regexp_replace("next_url", "^(https?://)", "$1mirror-"), F.lit('">'))
    linked = pages.join(pairs.select("page_id", "next_url"), "page_id").select(
        "page_id", "url", F.concat(F.coalesce(refresh, F.lit("")), F.coalesce("html", F.lit(""))).alias("html"))
    seeds = at.groupBy("crawl_id").agg(F.min_by("norm_url", "page_id").alias("url"))
    order = F.array(F.col("page_id").cast("int")).alias("ord")
    listed = at.where("page_id % 2 = 0").select("crawl_id", F.col("norm_url").alias("loc"), order).unionByName(
        pairs.where("next_host <> crawl_id").select("crawl_id", F.col("next_url").alias("loc"), order))
    return linked, seeds, listed
