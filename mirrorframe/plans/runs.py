"""Registered queries of crawls at table size, repeated runs, stylesheets,
path options and streams in event time, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import urls as U
from ..operators import extract as X
from ..session import scratch_path
from ..sources.tables import pages as read_pages
from ..sources.tables import read_table
from . import derived
from .catalog import _JOB_COLS, _JOBS_SQL, KNOWN_SQL, PAGE_SQL, PAGES_NORM_SQL, _events, register

#: More pages than any table has: the crawl ends where the links end.
NO_CAP = 1 << 62


# ---------------------------------------------------------------------------
# I1 at table size: several sites at once, and the given pages themselves
# ---------------------------------------------------------------------------

@register("crawl_sites", r"""
WITH RECURSIVE p AS (SELECT page_id, page_id % 4 AS s, page_id // 4 AS i FROM pages),
r AS (
  SELECT s, i, page_id, 0 AS level FROM p WHERE i = 0
  UNION ALL
  SELECT p.s, p.i, p.page_id, r.level + 1 FROM r JOIN p ON p.s = r.s AND (p.i = 2 * r.i + 1 OR p.i = 2 * r.i + 2)
  WHERE NOT (p.s = 1 AND starts_with(CAST(p.i AS VARCHAR), '7')))
SELECT 'site' || s AS crawl_id, 'https://site' || s || '.example.com/p/' || i AS norm_url, page_id, level,
       row_number() OVER (PARTITION BY s ORDER BY i) AS crawl_rank
FROM r""")
def crawl_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sites of all pages of the table, crawled at once to the end."""
    from .crawl import crawl
    site, seeds, robots = derived.link_graph_sites(read_pages(spark, sf_dir))
    return crawl(site, seeds, CrawlConfig(max_pages=NO_CAP), robots=robots).select(
        "crawl_id", "norm_url", "page_id", "level", "crawl_rank")


_HOST_LINKS = PAGES_NORM_SQL + r""",
t AS (SELECT page_id, scheme, netloc, unnest(regexp_extract_all(html, '<a\s[^>]*>', 0)) AS tag FROM pc),
h AS (SELECT page_id, scheme, netloc, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM t),
l AS (SELECT netloc, scheme || '://' || netloc || coalesce(nullif(rtrim(href, '/'), ''), '/') AS target FROM (
        SELECT *, lower(regexp_extract(substr(href, 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM h WHERE href LIKE '/%')
      WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r""")))"""


@register("crawl_hosts", "WITH " + _HOST_LINKS + r""",
g AS (SELECT netloc, page_id, norm_url, row_number() OVER (PARTITION BY netloc ORDER BY page_id) AS crawl_rank FROM pc),
v AS (SELECT netloc, count(DISTINCT u) AS visited FROM (
        SELECT netloc, norm_url AS u FROM pc UNION ALL SELECT netloc, target FROM l) GROUP BY netloc),
k AS (SELECT netloc, count(*) AS pages_cloned FROM g GROUP BY netloc)
SELECT netloc AS crawl_id, page_id, norm_url, 0 AS level, crawl_rank, pages_cloned, visited, 0 AS queue_len, pages_cloned AS sitemap_urls
FROM g JOIN v USING (netloc) JOIN k USING (netloc)""")
def crawl_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages over their own html: one crawl a host, seeded with its
    first page and, as a sitemap would, with all of its pages; no cap."""
    from .crawl import crawl_with_counts
    pages = read_pages(spark, sf_dir)
    corpus = X.corpus(pages).select("page_id", "norm_url", U.authority("norm_url").alias("crawl_id"))
    seeds = corpus.groupBy("crawl_id").agg(F.min_by("norm_url", "page_id").alias("url"))
    listed = corpus.select("crawl_id", F.col("norm_url").alias("loc"), F.array(F.col("page_id").cast("int")).alias("ord"))
    got, counts = crawl_with_counts(pages, seeds, CrawlConfig(max_pages=NO_CAP), sitemap_urls=listed)
    return got.select("crawl_id", "page_id", "norm_url", "level", "crawl_rank").join(counts, "crawl_id")


@register("crawl_strict", "WITH " + PAGES_NORM_SQL + r""",
f AS (SELECT netloc, min(page_id) AS first FROM pc GROUP BY netloc)
SELECT c.netloc AS crawl_id, c.page_id, c.norm_url, CASE WHEN c.page_id % 2 = 0 OR c.page_id = first THEN 0 ELSE 1 END AS level
FROM pc c JOIN f ON f.netloc = c.netloc LEFT JOIN pc b ON b.page_id = c.page_id - 1 AND b.netloc = c.netloc
WHERE c.page_id % 2 = 0 OR c.page_id = first OR b.page_id IS NOT NULL""")
def crawl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``strict_scope`` (meta refreshes and sitemaps that lead to other hosts
    are not followed) and F2 (refreshes to a mirror are mapped back) in a
    crawl of every host of the given pages."""
    from .crawl import crawl
    linked, seeds, listed = derived.refreshed_hosts(read_pages(spark, sf_dir))
    return crawl(linked, seeds, CrawlConfig(max_pages=NO_CAP, strict_scope=True), sitemap_urls=listed,
                 map_url=lambda u: F.regexp_replace(u, "^(https?://)mirror-", "$1")).select(
        "crawl_id", "page_id", "norm_url", "level")


@register("decoded_sheets", r"""
WITH d AS (SELECT doc_id, '/* ' || coalesce(text, '') || ' */ i{background:url(/f/é' || doc_id || '.png)}' AS css FROM documents),
k AS (SELECT *, doc_id % 2 = 1 AND NOT regexp_matches(css, '[^\x{00}-\x{FF}]') AS latin FROM d)
SELECT doc_id, latin, CAST(CASE WHEN latin THEN length(css) ELSE strlen(css) END AS BIGINT) AS n_bytes, md5(css) AS decoded_md5,
       '/f/é' || doc_id || '.png' AS last_ref
FROM k""")
def decoded_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U14 on a stylesheet per document, stored in UTF-8 or, where it can be, every other one in Latin-1."""
    from ..functions import css as C
    css = F.concat(F.lit("/* "), F.coalesce("text", F.lit("")), F.lit(" */ i{background:url(/f/é"),
                   F.col("doc_id").cast("string"), F.lit(".png)}"))
    sheets = read_table(spark, sf_dir, "documents").select("doc_id", css.alias("css")).withColumn(
        "latin", (F.col("doc_id") % 2 == 1) & ~F.col("css").rlike(r"[^\x{00}-\x{FF}]"))
    stored = sheets.select("doc_id", "latin", F.when(F.col("latin"), F.encode("css", "ISO-8859-1"))
                           .otherwise(F.encode("css", "UTF-8")).alias("body"))
    text = stored.select("doc_id", "latin", F.octet_length("body").cast("long").alias("n_bytes"),
                         C.decode_css("body").alias("css"))
    return text.select("doc_id", "latin", "n_bytes", F.md5("css").alias("decoded_md5"),
                       F.element_at(C.css_url_refs("css"), -1).alias("last_ref"))


@register("page_hosts", "WITH " + _HOST_LINKS + r""",
a AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':[^:]*$', '')) AS host FROM pc),
d AS (SELECT *, ('0x' || substr(md5(host), 1, 2))::INT AS k FROM a),
e AS (SELECT *, CASE k % 4 WHEN 0 THEN '10.0.0.' || k WHEN 1 THEN '93.184.216.' || k WHEN 2 THEN '127.0.0.1' END AS ip FROM d)
SELECT host, ip, coalesce(k % 4 IN (0, 2), false) AS is_private, (SELECT count(*) FROM l WHERE lower(l.netloc) = host) AS links
FROM e""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U9/J4/P4 on the hosts that the given pages and their links name, with
    addresses for three in four of them."""
    from ..operators.policy import block_private
    corpus = X.corpus(read_pages(spark, sf_dir))
    links = X.extract_links(X.with_tokens(corpus), base_col="norm_url").select(F.col("norm_url").alias("url"))
    urls = corpus.select(F.col("norm_url").alias("url"), F.lit(0).alias("n")).unionByName(links.withColumn("n", F.lit(1)))
    hosts = urls.groupBy(U.host_of("url").alias("name")).agg(F.min("url").alias("url"), F.sum("n").alias("links"))
    k = F.conv(F.substring(F.md5("name"), 1, 2), 16, 10).cast("int")
    dns = hosts.select(F.col("name").alias("host"), (
        F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("93.184.216."), k.cast("string")))
        .when(k % 4 == 2, "127.0.0.1")).alias("ip")).where("ip IS NOT NULL")
    return block_private(hosts, "url", dns).select("host", "ip", F.coalesce("is_private", F.lit(False)).alias("is_private"), "links")


# ---------------------------------------------------------------------------
# S3/J6/R1 snapshot upkeep over runs, S6 written site, W5 collisions
# ---------------------------------------------------------------------------

@register("snapshot_upkeep", r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
o AS (
  SELECT 'doc://' || doc_id AS url, doc_id % 3 AS v, text,
         doc_id % 11 <> 0 AND doc_id % 7 = 0 AS changed, doc_id % 3 = 1 AND doc_id % 5 = 0 AND doc_id % 11 <> 0 AS told
  FROM d WHERE doc_id % 10 <> 9 AND doc_id % 13 <> 0),
n AS (SELECT *, CASE WHEN changed THEN text || ' [edited]' ELSE text END AS body FROM o)
SELECT url, CASE WHEN v = 0 THEN md5(body) END AS etag,
       CASE WHEN v = 1 THEN CASE WHEN changed THEN 'v2' WHEN told THEN 'v1b' ELSE 'v1' END END AS last_modified,
       md5(body) AS md5, CAST(strlen(body) AS BIGINT) AS size,
       CASE WHEN changed THEN '2024-01-02' ELSE '2024-01-01' END AS fetched, 0 AS missed, 'unchanged' AS change FROM n
UNION ALL
SELECT 'doc://' || (doc_id + 100000000), NULL, NULL, md5(text), CAST(strlen(text) AS BIGINT), '2024-01-02', 1, 'gone'
FROM d WHERE doc_id % 10 = 5""")
def snapshot_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the documents: fetched, then 304s, changes, failures
    and missing ones, then again; URLs missed twice leave."""
    from ..operators.snapshot import latest_answers, merge_snapshot
    held = None
    for responses in derived.document_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")):
        held = merge_snapshot(held, latest_answers(responses, 1 << 40), max_missed=1)
    return held.select("url", "etag", "last_modified", "md5", "size", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"),
                       "missed", "change")


@register("clone_two_runs", r"""
WITH RECURSIVE r(id) AS (
  SELECT page_id FROM pages WHERE page_id = 0
  UNION ALL
  SELECT c.page_id FROM r JOIN pages c ON c.page_id = 2 * r.id + 1 OR c.page_id = 2 * r.id + 2),
b AS (SELECT id, id % 4 AS k, CASE WHEN id % 4 = 1 THEN 'NEW' ELSE 'PNG' END || id AS body FROM r)
SELECT 'https://site.example.com/img/' || id || '.png' AS url,
       CASE WHEN k = 1 THEN 'f' ELSE 'e' END || id AS etag, md5(body) AS md5, CAST(strlen(body) AS BIGINT) AS size,
       CASE WHEN k = 2 THEN 1 ELSE 0 END AS missed,
       CASE k WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'gone' ELSE 'kept' END AS change,
       'If-None-Match: ' || CASE WHEN k = 1 THEN 'f' ELSE 'e' END || id AS next_request
FROM b""")
def clone_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 twice over the whole table as one site: the second run starts from
    the first one's snapshot and gets 304s, new bodies, 404s and failures."""
    from ..operators.snapshot import request_header
    from .clone import Hooks, clone_run
    pages = read_pages(spark, sf_dir)
    site = derived.link_graph_site(pages)
    seeds = spark.createDataFrame([("site", derived.SITE + "/p/0")], "crawl_id string, url string")
    held = None
    for responses in derived.image_runs(pages):
        held = clone_run(site, seeds, CrawlConfig(max_pages=NO_CAP), responses=responses, snapshot=held,
                         hooks=Hooks(after_html=derived.page_image_hook)).snapshot
    return held.select("url", "etag", "md5", "size", "missed", "change",
                       request_header("etag", "last_modified").alias("next_request"))


@register("write_site_runs", r"""
SELECT source AS crawl_id, 'd/' || doc_id || '.txt' AS local_path,
       md5(CASE WHEN source = (SELECT min(source) FROM documents) THEN text || '!' ELSE text END) AS md5
FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND NOT (source = (SELECT min(source) FROM documents) AND doc_id % 2 = 1)""")
def write_site_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls written into one path one after the other, the first again
    with other files: it replaces itself and no other."""
    from ..operators.snapshot import write_site
    docs = read_table(spark, sf_dir, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    files = docs.select(F.col("source").alias("crawl_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias(
        "local_path"), F.encode("text", "UTF-8").alias("content"), "doc_id")
    first = F.col("crawl_id") == F.lit(docs.agg(F.min("source")).first()[0])
    path = scratch_path(spark, "site")
    write_site(files.where(first), path)
    write_site(files.where(~first), path)
    write_site(files.where(first & (F.col("doc_id") % 2 == 0)).withColumn("content", F.concat("content", F.encode(F.lit("!"), "UTF-8"))), path)
    return spark.read.parquet(path).select("crawl_id", "local_path", F.md5("content").alias("md5"))


_PATHS_SQL = PAGES_NORM_SQL + r""",
q AS (SELECT page_id, norm_url, netloc, CASE WHEN coalesce(nullif(rtrim(path, '/'), ''), '/') = '/' THEN 'index.html'
             ELSE ltrim(rtrim(path, '/'), '/') END AS lp0 FROM pn),
f AS (SELECT page_id, norm_url, netloc, CASE WHEN lower(regexp_extract(regexp_extract(lp0, '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1))
                  IN (""" + KNOWN_SQL + r""") THEN lp0 ELSE lp0 || '.html' END AS local_path FROM q)"""


@register("path_collisions", "WITH " + _PATHS_SQL + r""",
u AS (SELECT local_path, norm_url AS source_url, max(page_id) AS last FROM f GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY local_path) AS writers, last = max(last) OVER (PARTITION BY local_path) AS won FROM u)
SELECT 'all' AS crawl_id, local_path, source_url, writers, won FROM w WHERE writers > 1""")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: all pages stored by their paths in one crawl: who writes a path
    that others write too, and who is left."""
    from ..operators.snapshot import collision_report
    files = read_pages(spark, sf_dir).select(
        F.lit("all").alias("crawl_id"), U.normalize_url("url").alias("source_url"), F.col("page_id").alias("write_seq"))
    return collision_report(files.withColumn("local_path", U.file_path("source_url")))


@register("external_paths", "WITH " + _PATHS_SQL + r""",
s AS (SELECT min(netloc) AS home FROM f),
c AS (SELECT CASE WHEN netloc = home THEN local_path
             ELSE '_external/' || regexp_replace(lower(netloc), '[^a-z0-9.\-]', '_', 'g') || '/' || local_path END AS path, norm_url FROM f, s),
m AS (SELECT path, count(DISTINCT norm_url) AS writers FROM c GROUP BY path)
SELECT DISTINCT norm_url AS url, path AS local_path, writers FROM c JOIN m USING (path)""")
def external_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: the same pages in a crawl of one host, the others' below
    ``_external/``, with the number of URLs that still share a path."""
    urls = read_pages(spark, sf_dir).select(U.normalize_url("url").alias("url")).distinct()
    home = urls.agg(F.min(U.authority("url")).alias("home"))
    put = urls.crossJoin(F.broadcast(home)).select("url", U.external_path(F.col("url"), None, F.col("home")).alias("local_path"))
    shared = put.groupBy("local_path").agg(F.count("*").alias("writers"))
    return put.join(shared, "local_path").select("url", "local_path", "writers")


@register("relative_links", "WITH " + _PATHS_SQL + r""",
p AS (SELECT page_id, local_path AS own FROM f),
t AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*>', 0) AS tags FROM pc),
e AS (SELECT page_id, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM t),
h AS (SELECT page_id, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM e),
x AS (SELECT *, lower(regexp_extract(regexp_extract(substr(href, 2), '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM h WHERE href LIKE '/%'),
g AS (SELECT page_id, pos, href, CASE WHEN href = '/' THEN 'index.html' WHEN ext IN (""" + KNOWN_SQL + r""") THEN ltrim(href, '/')
             WHEN href LIKE '%/' THEN ltrim(href, '/') || 'index.html' ELSE ltrim(href, '/') || '.html' END AS target
      FROM x WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r"""))),
y AS (SELECT g.*, own, string_split(own, '/')[:-2] AS here, string_split(target, '/') AS there FROM g JOIN p USING (page_id)),
k AS (SELECT *, len(list_filter(range(1, least(len(here), len(there) - 1) + 1), lambda i: here[1:i] = there[1:i])) AS same FROM y)
SELECT page_id, pos, own, target, repeat('../', len(here) - same) || array_to_string(there[same + 1:], '/') AS reference FROM k""")
def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the references of all pages' links, relative to the page's file."""
    corpus = X.corpus(read_pages(spark, sf_dir))
    links = X.extract_links(X.with_tokens(corpus), base_col="norm_url")
    links = links.select("page_id", "pos", U.file_path(F.col("abs_url")).alias("target"))
    own = corpus.select("page_id", U.file_path("norm_url").alias("own"))
    return links.join(own, "page_id").select("page_id", "pos", "own", "target",
                                             U.relative_path(F.col("own"), F.col("target")).alias("reference"))


@register("response_paths", "WITH " + _PATHS_SQL + r""",
b AS (SELECT norm_url AS url, any_value(lp0) AS lp0, min(page_id) % 4 AS k FROM q GROUP BY norm_url),
c AS (SELECT *, regexp_extract(regexp_extract(lp0, '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1) AS own,
             CASE k WHEN 0 THEN '.png' WHEN 1 THEN '.css' WHEN 2 THEN '.html' ELSE '.json' END AS ext FROM b)
SELECT url, CASE WHEN own = '' THEN lp0 || ext ELSE lp0 END AS local_path FROM c
WHERE lower(own) NOT IN (""" + KNOWN_SQL + r""") AND NOT (own = '' AND ext = '.html')""")
def response_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: paths of all page URLs by the type that the server answered."""
    from ..operators.snapshot import path_map
    urls = read_pages(spark, sf_dir).select(U.normalize_url("url").alias("url"), "page_id")
    urls = urls.groupBy("url").agg(F.min("page_id").alias("page_id"))
    kind = F.element_at(F.array(*map(F.lit, ["image/png", "text/css; charset=utf-8", "text/html", "application/json"])),
                        (F.col("page_id") % 4 + 1).cast("int"))
    refs = urls.select(F.lit("c").alias("crawl_id"), "url", F.lit(None).cast("string").alias("content_type"), F.lit(0).alias("seq"))
    return path_map(refs, urls.select("url", kind.alias("content_type"))).select("url", "local_path")


# ---------------------------------------------------------------------------
# Q8 stylesheets that import stylesheets, W2 with files that follow a sheet
# ---------------------------------------------------------------------------

@register("sheet_closure", r"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages),
r(crawl, id, level) AS (
  SELECT c, c, 0 FROM (SELECT unnest(range(3)) AS c), n WHERE c < n
  UNION
  SELECT crawl, t, level + 1 FROM (SELECT r.crawl, r.level, unnest([(2 * r.id + 1) % n, r.id, (r.id * r.id + 3) % n]) AS t FROM r, n WHERE r.level < 5))
SELECT 'c' || crawl AS crawl_id, 'https://site.example.com/css/' || id || '.css' AS url, min(level) AS level FROM r GROUP BY crawl, id""")
def sheet_closure_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that import each other in circles, one per page of the table:
    what three crawls read in six levels."""
    from ..operators.stylesheets import sheet_closure, sheet_edges
    sheets = derived.importing_sheets(read_pages(spark, sf_dir))
    roots = sheets.where("page_id < 3").select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("crawl_id"), "url",
                                               F.lit(0).alias("seq"))
    return sheet_closure(roots, sheet_edges(sheets.select("url", "css")), depth=6).select("crawl_id", "url", "level")


SHEET_TOTAL, SHEET_ASSET = 300.0, 44.0


@register("sheet_budget", r"""
WITH RECURSIVE li AS (
  SELECT l_orderkey % 50 AS k, l_orderkey AS o, l_linenumber AS n, 's' || l_orderkey AS sheet, l_partkey % 300 AS f FROM lineitem),
m AS (
  SELECT DISTINCT k, o, 0 AS n, sheet AS item, NULL::VARCHAR AS parent, (o * 7) % 60 + 1.0 AS size FROM li
  UNION ALL SELECT k, o, n, 'f' || f, sheet, (f * 5) % 50 + 1.0 FROM li),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, n, item) AS rn FROM m),
walk(k, rn, rem, got) AS (
  SELECT DISTINCT k, 0::BIGINT, 300.0::DOUBLE, []::VARCHAR[] FROM s
  UNION ALL
  SELECT w.k, s.rn, CASE WHEN x.ok THEN w.rem - s.size ELSE w.rem END, CASE WHEN x.ok THEN list_append(w.got, s.item) ELSE w.got END
  FROM walk w JOIN s ON s.k = w.k AND s.rn = w.rn + 1,
  LATERAL (SELECT s.size <= 44 AND s.size <= w.rem AND NOT list_contains(w.got, s.item)
                  AND (s.parent IS NULL OR list_contains(w.got, s.parent)) AS ok) x),
a AS (SELECT k, unnest(got) AS item FROM walk QUALIFY rn = max(rn) OVER (PARTITION BY k))
SELECT k AS crawl_id, item, min(s.size)::DOUBLE AS size FROM a JOIN s USING (k, item) GROUP BY ALL""")
def sheet_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stylesheets, their lines as files that they refer to
    (a part may be met in many orders): most sheets are turned away."""
    from ..operators.policy import offered_budget
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey")
    key, sheet = F.col("l_orderkey") % 50, F.concat(F.lit("s"), F.col("l_orderkey").cast("string"))
    part = F.col("l_partkey") % 300
    files = li.select(key.alias("crawl_id"), F.col("l_orderkey").alias("o"), "n", F.concat(F.lit("f"), part.cast("string")).alias("item"),
                      sheet.alias("parent"), (part * 5 % 50 + 1).cast("double").alias("size"))
    sheets = li.select("l_orderkey").distinct().select(
        key.alias("crawl_id"), F.col("l_orderkey").alias("o"), F.lit(0).alias("n"), sheet.alias("item"),
        F.lit(None).cast("string").alias("parent"), (F.col("l_orderkey") * 7 % 60 + 1).cast("double").alias("size"))
    every = sheets.unionByName(files)
    met = every.dropDuplicates(["crawl_id", "o", "n", "item"])
    got = offered_budget(met, "crawl_id", "item", ["o", "n", "item"], "parent", "size", SHEET_ASSET, SHEET_TOTAL)
    got = got.select("crawl_id", "item")
    sizes = every.join(got.distinct(), ["crawl_id", "item"], "left_semi").groupBy("crawl_id", "item").agg(F.min("size").alias("size"))
    return got.join(sizes, ["crawl_id", "item"])


# ---------------------------------------------------------------------------
# T2 timers, T3 behind a watermark, T4 out of order
# ---------------------------------------------------------------------------

TTL_SECONDS, TTL_DELAY = 4 * 86400, 86400


@register("job_ttl_stream", _JOBS_SQL + r"""
WHERE job_id IN (SELECT job_id FROM e GROUP BY job_id
                 HAVING epoch_ms(min(ts)) + """ + f"{TTL_SECONDS * 1000} > (SELECT epoch_ms(max(ts)) - {TTL_DELAY * 1000} FROM events))")
def job_ttl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job patches in six batches; a job's state ends four days after
    its creation, by a timer."""
    from ..operators.jobs import job_patches_from_events
    from ..streaming.live import expiring_jobs, live_job_table
    patches = job_patches_from_events(_events(spark, sf_dir))
    day = F.datediff("ts", F.lit("2024-01-01"))
    path, schema = derived.as_batches(patches, (day / 5).cast("int"), "patches")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs = live_job_table(expiring_jobs(stream, f"{TTL_DELAY} seconds", TTL_SECONDS), "ttl")
    return jobs.withColumn("progress", U.progress_pct("pages_cloned", "max_pages", F.col("status"))).select(*_JOB_COLS)


@register("frontier_watermark", r"""
WITH n AS (SELECT count(*) AS n FROM pages),
p AS (SELECT page_id AS i, page_id * 6 // n AS part FROM pages, n),
a AS (SELECT i FROM p WHERE NOT (i % 9 = 4 AND part >= 2)),
l AS (SELECT DISTINCT unnest([2 * i + 1, 2 * i + 2, abs(2 * i - 1)]) AS t FROM a)
SELECT 'https://site.example.com/p/' || t AS norm_url, 'site.example.com' AS host FROM l""")
def frontier_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 with bounded state: pages arrive in six batches, every ninth twelve
    hours late.  The engine judges a batch by the watermark that the batch before it
    was planned with, so late pages are dropped from the third batch on; the
    others' links are emitted once."""
    from ..streaming.live import run_available, streaming_frontier
    dated = derived.dated_pages(read_pages(spark, sf_dir))
    path, schema = derived.as_batches(dated, F.col("part"), "dated")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run_available(streaming_frontier(stream, "30 minutes"), "dated").select("norm_url", "host")


LATE_DELAY = 3 * 86400


@register("token_bucket_reordered", r"""
WITH e AS (SELECT event_id, 'h' || (user_id % 5) AS host, epoch_us(ts) / 1e6 AS arrival,
                  CASE WHEN event_id % 97 = 0 THEN 9 ELSE (date_diff('day', DATE '2024-01-01', ts::DATE) + event_id % 3) // 4 END AS part FROM events),
f AS (SELECT *, part = 9 AND arrival <= (SELECT max(arrival) - """ + str(LATE_DELAY) + r""" FROM e WHERE part < 9) AS late FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, event_id) - 1 AS n FROM f WHERE NOT late),
s AS (SELECT *, greatest(arrival, (n - 19) / 10.0 + max(arrival - n / 10.0) OVER (
        PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS start_at FROM n)
SELECT event_id, host, round(arrival, 6) AS arrival, round(start_at, 3) AS start_at, round(start_at - arrival, 3) AS wait_s, late FROM s
UNION ALL SELECT event_id, host, round(arrival, 6), NULL, NULL, late FROM f WHERE late""")
def token_bucket_reordered_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: arrivals up to two days out of order over nine batches, and some
    that come at the very end."""
    from ..streaming.live import token_bucket_reordered
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"),
        F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    part = F.when(F.col("event_id") % 97 == 0, 9).otherwise(((F.col("day") + F.col("event_id") % 3) / 4).cast("int"))
    path, schema = derived.as_batches(ev.select("event_id", "host", "arrival", part.alias("part")), F.col("part"), "requests")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("part")
    return token_bucket_reordered(stream, "reordered", LATE_DELAY).select("event_id", "host", *[
        F.round(c, k).alias(c) for c, k in (("arrival", 6), ("start_at", 3), ("wait_s", 3))], "late")
