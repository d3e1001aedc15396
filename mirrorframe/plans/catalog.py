"""Registered queries over the driver tables, each paired with an
independent DuckDB statement of the expected answer.

Every query reads whole tables.  Where an operator needs markup the corpus
lacks (assets, CSS, a link graph, robots files, sitemaps), ``derived.py``
builds input rows from the tables and the operator does all of its work on
them; the DuckDB statement then computes the expected rows by arithmetic
from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KNOWN_EXTS, PAGE_EXTS
from ..functions import urls as U
from ..operators import extract as X
from ..sources.tables import pages as read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _sql_list(xs) -> str:
    return ", ".join("'" + x + "'" for x in xs)


KNOWN_SQL = _sql_list(KNOWN_EXTS)
PAGE_SQL = _sql_list(PAGE_EXTS)

# Page URL pieces and normalised URL in DuckDB (all corpus URLs are absolute
# http(s) URLs without ;params).
PAGES_NORM_SQL = r"""
pp AS (
  SELECT page_id, url, html,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS netloc,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
pn AS (
  SELECT *, scheme || '://' || netloc || coalesce(nullif(rtrim(path, '/'), ''), '/')
            || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS norm_url
  FROM pp),
pc AS (
  SELECT pn.* FROM pn
  JOIN (SELECT norm_url, min(page_id) AS page_id FROM pn GROUP BY norm_url) m USING (norm_url, page_id))
"""


# ---------------------------------------------------------------------------
# Flagship: frontier per host
# ---------------------------------------------------------------------------

def frontier_by_host_df(pages: DataFrame) -> DataFrame:
    """pages -> corpus (S1) -> links (H1, H2: U3 resolve, U4 scope, U5 page
    test) -> U2 normalise -> A1 distinct per host with U6/U7 local path and
    in-link counts."""
    links = X.extract_links(X.with_tokens(X.corpus(pages)), base_col="norm_url")
    return (links.groupBy(U.authority("norm_url").alias("host"), "norm_url")
            .agg(F.count(F.lit(1)).alias("in_links"), F.countDistinct("page_id").alias("n_pages"))
            .withColumn("local_path", U.file_path(F.col("norm_url"))))


@register("frontier_by_host", "WITH " + PAGES_NORM_SQL + r""",
l AS (SELECT page_id, scheme, netloc,
             unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pc),
lk AS (SELECT page_id, netloc AS host, scheme || '://' || netloc || href AS norm_url,
              substr(href, 2) AS word,
              lower(regexp_extract(substr(href, 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext
       FROM l WHERE href LIKE '/%')
SELECT host, norm_url,
       CASE WHEN ext IN (""" + KNOWN_SQL + r""") THEN word ELSE word || '.html' END AS local_path,
       count(*) AS in_links, count(DISTINCT page_id) AS n_pages
FROM lk
WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r"""))
GROUP BY host, norm_url, local_path""")
def frontier_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier_by_host_df(read_pages(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scalar URL functions over every page URL
# ---------------------------------------------------------------------------

@register("url_table", r"""
WITH u AS (
  SELECT page_id, url,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS netloc,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
         regexp_extract(url, '#(.*)$', 1) AS fragment
  FROM pages),
v AS (
  SELECT *, coalesce(nullif(rtrim(path, '/'), ''), '/') AS npath FROM u),
w AS (
  SELECT *, scheme || '://' || netloc || npath || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS norm_url,
         CASE WHEN npath = '/' THEN 'index.html' ELSE ltrim(npath, '/') END AS lp0,
         lower(regexp_extract(regexp_extract(lower(path), '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1)) AS pext
  FROM v)
SELECT page_id, url, scheme, netloc, path, query, fragment, norm_url,
       CASE WHEN lower(regexp_extract(regexp_extract(lp0, '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1))
                 IN (""" + KNOWN_SQL + r""") THEN lp0 ELSE lp0 || '.html' END AS local_path,
       (path IN ('', '/') OR pext NOT IN (""" + KNOWN_SQL + r""") OR pext IN (""" + PAGE_SQL + r""")) AS is_html,
       scheme IN ('http', 'https') AS valid_scheme,
       'https://' || netloc AS site_url
FROM w""")
def url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_pages(spark, sf_dir).select("page_id", "url")
    parts = p.withColumn("p", U.url_parts("url"))
    return parts.select(
        "page_id", "url", "p.scheme", "p.netloc", "p.path", "p.query", "p.fragment",
        U.normalize_url("url").alias("norm_url"),
        U.file_path(U.normalize_url("url")).alias("local_path"),
        U.is_html_link("url").alias("is_html"),
        U.valid_scheme("url").alias("valid_scheme"),
        U.ensure_scheme(F.concat(F.lit(" "), F.col("p.netloc"))).alias("site_url"))


# ---------------------------------------------------------------------------
# H2 links per page
# ---------------------------------------------------------------------------

@register("page_links", "WITH " + PAGES_NORM_SQL + r""",
t AS (SELECT page_id, scheme, netloc, regexp_extract_all(html, '<a\s[^>]*>', 0) AS tags FROM pc),
e AS (SELECT page_id, scheme, netloc, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM t),
h AS (SELECT page_id, pos, scheme, netloc, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM e),
r AS (SELECT page_id, pos, href, scheme || '://' || netloc || href AS abs_url,
             lower(regexp_extract(substr(href, 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext
      FROM h WHERE href LIKE '/%')
SELECT page_id, pos, href, abs_url, abs_url AS norm_url FROM r
WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r"""))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.corpus(read_pages(spark, sf_dir))
    return X.extract_links(X.with_tokens(c), base_col="norm_url").select(
        "page_id", "pos", "href", "abs_url", "norm_url")


# ---------------------------------------------------------------------------
# H3-H6 assets, H7 meta refresh, H8/H10/H11 CSS references, H12 CSS rewrite
# ---------------------------------------------------------------------------

_ORIGIN_SQL = r"""
o AS (SELECT page_id, url, html,
             lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' ||
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS origin,
             regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1),
                            '^(.*/)', 1) AS dir
      FROM pages)"""


def _markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    return derived.asset_markup(read_pages(spark, sf_dir))


@register("page_assets", "WITH " + _ORIGIN_SQL + r"""
SELECT page_id, 'img' AS tag, 'src' AS attr, -1 AS srcset_idx, origin || '/img/' || (page_id % 7) || '.png' AS abs_url,
       NULL AS content_type, 'img/' || (page_id % 7) || '.png' AS local_path, false AS is_stylesheet FROM o
UNION ALL
SELECT page_id, 'img', 'srcset', 0, origin || '/s/' || page_id || '.jpg', NULL, 's/' || page_id || '.jpg', false FROM o
UNION ALL
SELECT page_id, 'img', 'srcset', 1, origin || '/l/' || page_id || '.jpg', NULL, 'l/' || page_id || '.jpg', false FROM o
UNION ALL
SELECT page_id, 'link', 'href', -1, origin || '/css/' || (page_id % 3) || '.css', 'text/css',
       'css/' || (page_id % 3) || '.css', true FROM o
UNION ALL
SELECT page_id, 'script', 'src', -1, origin || '/js/' || (page_id % 5), 'application/javascript',
       'js/' || (page_id % 5) || '.js', false FROM o""")
def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.extract_assets(X.with_tokens(_markup_pages(spark, sf_dir)))
    return a.select("page_id", "tag", "attr", "srcset_idx", "abs_url", "content_type", "local_path",
                    "is_stylesheet")


@register("meta_refresh", "WITH " + _ORIGIN_SQL + r"""
SELECT page_id, -1 AS pos, origin || '/news/' || page_id AS abs_url, origin || '/news/' || page_id AS norm_url
FROM o WHERE page_id % 10 = 0""")
def meta_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.extract_meta_refresh(X.with_tokens(_markup_pages(spark, sf_dir)))


@register("css_refs", "WITH " + _ORIGIN_SQL + r""",
b AS (SELECT *, len(regexp_extract_all(html, '<style', 0)) AS pos FROM o)
SELECT page_id, pos, 'url' AS kind, 0 AS ref_pos, origin || '/bg/' || (page_id % 4) || '.png' AS abs_url,
       'bg/' || (page_id % 4) || '.png' AS local_path FROM b
UNION ALL
SELECT page_id, pos, 'import', 0, origin || dir || 'x' || (page_id % 2) || '.css',
       ltrim(dir, '/') || 'x' || (page_id % 2) || '.css' FROM b""")
def css_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = X.extract_style_blocks(X.with_tokens(_markup_pages(spark, sf_dir)), keep=["url"])
    return X.extract_css_refs(styles, base_col="url", keep=["page_id", "pos"]).select(
        "page_id", "pos", "kind", "ref_pos", "abs_url", "local_path")


_CSS_OUT_SQL = r"""'body{background:url("bg/' || (page_id % 4) || '.png")} @import "' || ltrim(dir, '/') || 'x'
       || (page_id % 2) || '.css"; i{background:url(data:x)}'"""


@register("css_rewrite", "WITH " + _ORIGIN_SQL + r""",
b AS (SELECT *, regexp_extract_all(html, '<style>([^<]*)</style>', 1) AS blocks FROM o)
SELECT page_id, unnest(range(len(blocks))) AS pos, unnest(blocks) AS css FROM b
UNION ALL
SELECT page_id, len(blocks) AS pos, """ + _CSS_OUT_SQL + r""" AS css FROM b""")
def css_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import css as C
    styles = X.extract_style_blocks(X.with_tokens(_markup_pages(spark, sf_dir)), keep=["url"])
    return styles.select("page_id", "pos", C.rewrite_css("css", "url").alias("css"))


# ---------------------------------------------------------------------------
# H13-H16 + J5 + H9: page rewrite for offline viewing
# ---------------------------------------------------------------------------

@register("page_rewrite", "WITH " + _ORIGIN_SQL + r"""
SELECT page_id,
       regexp_replace(html, '<a href="/([^"]*)">', '<a href="\1.html">', 'g')
       || CASE WHEN page_id % 10 = 0 THEN '<meta http-equiv="Refresh" content="0; url=/news/' || page_id || '">'
               ELSE '' END
       || '<img src="img/' || (page_id % 7) || '.png" srcset="s/' || page_id || '.jpg 1x, l/' || page_id
       || '.jpg 2x"><link rel="stylesheet" href="css/' || (page_id % 3) || '.css"><script src="/js/'
       || (page_id % 5) || '"></script><style>' || """ + _CSS_OUT_SQL + r""" || '</style>' AS html
FROM o""")
def page_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.rewrite import rewrite_pages
    pages = read_pages(spark, sf_dir)
    return rewrite_pages(derived.asset_markup(pages), fetched=derived.asset_responses(pages))


# ---------------------------------------------------------------------------
# S5 robots parsing, J3/P3 robots test
# ---------------------------------------------------------------------------

_ROBOTS_HOSTS_SQL = r"""
hs AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS host FROM pages),
hr AS (SELECT host, CASE WHEN host LIKE 'blog.%' THEN 403 WHEN host LIKE 'm.%' THEN 404
                         WHEN host LIKE 'www.%' THEN 503 ELSE 200 END AS status,
              substr(host, 1, 1) AS f FROM hs)"""


@register("robots_rules", "WITH " + _ROBOTS_HOSTS_SQL + r"""
SELECT host, 5 AS line_no, true AS allow, '/' || f || 'x' AS prefix FROM hr WHERE status = 200
UNION ALL SELECT host, 6, false, '/' || f FROM hr WHERE status = 200
UNION ALL SELECT host, 7, false, '/a' FROM hr WHERE status = 200
UNION ALL SELECT host, -1, false, '' FROM hr WHERE status IN (403, 503)""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.robots import parse_robots
    return parse_robots(derived.host_robots(read_pages(spark, sf_dir)))


@register("robots_allowed", "WITH " + PAGES_NORM_SQL + "," + _ROBOTS_HOSTS_SQL + r""",
t AS (SELECT page_id, scheme, netloc, regexp_extract_all(html, '<a\s[^>]*>', 0) AS tags FROM pc),
e AS (SELECT page_id, scheme, netloc, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM t),
h AS (SELECT page_id, pos, scheme, netloc, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM e),
r AS (SELECT page_id, pos, netloc, href, scheme || '://' || netloc || href AS norm_url,
             lower(regexp_extract(substr(href, 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext
      FROM h WHERE href LIKE '/%')
SELECT page_id, pos, norm_url,
       CASE WHEN hr.status IN (403, 503) THEN false
            WHEN hr.status = 404 THEN true
            WHEN starts_with(href, '/' || f || 'x') THEN true
            WHEN starts_with(href, '/' || f) OR starts_with(href, '/a') THEN false
            ELSE true END AS robots_allowed
FROM r JOIN hr ON hr.host = r.netloc
WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r"""))""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.robots import parse_robots, robots_filter
    pages = read_pages(spark, sf_dir)
    links = X.extract_links(X.with_tokens(X.corpus(pages)), base_col="norm_url")
    rules = parse_robots(derived.host_robots(pages))
    return robots_filter(links, rules).select("page_id", "pos", "norm_url", "robots_allowed")


# ---------------------------------------------------------------------------
# I1 crawl (J1, J2, A1, X1, W1, L1, P3) over a link-graph site
# ---------------------------------------------------------------------------

CRAWL_MAX_PAGES = 100


@register("crawl_site", r"""
WITH RECURSIVE r(id, lvl) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION ALL
  SELECT c.page_id, r.lvl + 1 FROM r JOIN pages c ON c.page_id = 2 * r.id + 1 OR c.page_id = 2 * r.id + 2
  WHERE NOT starts_with(CAST(c.page_id AS VARCHAR), '7'))
SELECT * FROM (
  SELECT 'https://site.example.com/p/' || id AS norm_url, id AS page_id, lvl AS level,
         row_number() OVER (ORDER BY id) AS crawl_rank
  FROM r) WHERE crawl_rank <= """ + str(CRAWL_MAX_PAGES))
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from .crawl import crawl
    from ..config import CrawlConfig
    from ..operators.robots import parse_robots
    site = derived.link_graph_site(read_pages(spark, sf_dir))
    seeds = spark.createDataFrame([("site", derived.SITE + "/p/0")], "crawl_id string, url string")
    robots = parse_robots(spark.createDataFrame([derived.site_robots()], "host string, status int, body string"))
    out = crawl(site, seeds, CrawlConfig(max_pages=CRAWL_MAX_PAGES), robots=robots)
    return out.select("norm_url", "page_id", "level", "crawl_rank")


# ---------------------------------------------------------------------------
# S4/I2/L2 sitemap expansion
# ---------------------------------------------------------------------------

@register("sitemap_urls", "WITH " + _ORIGIN_SQL + r"""
SELECT CAST(page_id AS VARCHAR) AS crawl_id, url AS loc, '0.0' AS ord_key FROM o
UNION ALL SELECT CAST(page_id AS VARCHAR), origin || '/x/' || page_id, '1.0' FROM o WHERE page_id % 2 = 0
UNION ALL SELECT CAST(page_id AS VARCHAR), origin || '/y/' || page_id, '1.1' FROM o WHERE page_id % 2 = 0""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from .crawl import expand_sitemaps
    roots, docs = derived.sitemap_docs(read_pages(spark, sf_dir))
    return expand_sitemaps(roots, docs).select("crawl_id", "loc", F.array_join("ord", ".").alias("ord_key"))


# ---------------------------------------------------------------------------
# S2/S3/U12 response outcomes, W6 retry plan
# ---------------------------------------------------------------------------

_RESP_SQL = r"""
r AS (
  SELECT event_id, 'https://api.example.com/u/' || user_id AS url, user_id, value, ts,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 429 ELSE 500 END
              WHEN event_type = 'view' THEN 200 WHEN event_type = 'click' THEN 304 ELSE 404 END AS status,
         CASE WHEN event_type = 'view' THEN 'text/html; charset=utf-8'
              WHEN event_type = 'purchase' THEN 'application/json' ELSE 'text/plain' END AS ct,
         CASE WHEN event_type = 'view' THEN floor(value * 1000) ELSE 0 END AS size,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
  FROM events),
o AS (
  SELECT *,
         CASE WHEN status = 429 THEN 'retry_429' WHEN status >= 400 THEN 'error'
              WHEN ct LIKE '%text/html%' OR ct LIKE '%text/plain%' THEN 'page' ELSE 'not_page' END AS page_outcome,
         CASE WHEN status = 429 THEN 'retry_429' WHEN status = 304 THEN 'unchanged' WHEN status >= 400 THEN 'error'
              WHEN size > 52428800 THEN 'too_large' WHEN size <= 0 THEN 'empty' ELSE 'accept' END AS asset_outcome,
         CASE WHEN status = 429 THEN
                   CASE WHEN event_id % 4 = 0 THEN floor(value)
                        ELSE greatest(0, floor(value) - (epoch_us(ts) % 1000000) / 1e6) END
              ELSE pow(2, attempt - 1) END AS wait_s
  FROM r)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.policy import number_attempts
    from ..sources.tables import read_table
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return number_attempts(derived.event_responses(ev))


@register("response_outcomes", "WITH " + _RESP_SQL + r"""
SELECT event_id, url, status, attempt, page_outcome, asset_outcome, round(wait_s, 3) AS wait_s FROM o""")
def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import policy as P
    r = _responses(spark, sf_dir)
    return r.select(
        "event_id", "url", "status", "attempt",
        P.classify_page("status", "content_type").alias("page_outcome"),
        P.classify_asset("status", "size").alias("asset_outcome"),
        F.round(P.retry_wait("status", "retry_after", "attempt", "ts"), 3).alias("wait_s"))


@register("retry_plan", "WITH " + _RESP_SQL + r""",
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY attempt DESC) = 1)
SELECT url, attempt, status, page_outcome AS outcome,
       CASE WHEN page_outcome NOT IN ('retry_429', 'error') THEN 'done'
            WHEN attempt >= 3 THEN 'fail' ELSE 'retry' END AS action,
       CASE WHEN page_outcome IN ('retry_429', 'error') AND attempt < 3
            THEN round(epoch_us(ts) / 1e6 + wait_s, 3) END AS next_at_s
FROM l""")
def retry_plan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import retry_plan
    p = retry_plan(_responses(spark, sf_dir), kind="page")
    return p.select("url", "attempt", "status", "outcome", "action",
                    F.round(F.unix_micros("next_at") / 1e6, 3).alias("next_at_s"))


# ---------------------------------------------------------------------------
# W2/P6 byte budget over lineitem (crawl = supplier, order = line, size = qty)
# ---------------------------------------------------------------------------

BUDGET_MAX_ASSET = 45.0
BUDGET_MAX_TOTAL = 1000.0


@register("byte_budget", r"""
WITH RECURSIVE li AS (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS size,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn
  FROM lineitem),
walk(l_suppkey, rn, rem, admitted) AS (
  SELECT l_suppkey, rn,
         CASE WHEN size <= 45 AND size <= 1000 THEN 1000 - size ELSE 1000 END,
         size <= 45 AND size <= 1000
  FROM li WHERE rn = 1
  UNION ALL
  SELECT li.l_suppkey, li.rn,
         CASE WHEN li.size <= 45 AND li.size <= w.rem THEN w.rem - li.size ELSE w.rem END,
         li.size <= 45 AND li.size <= w.rem
  FROM walk w JOIN li ON li.l_suppkey = w.l_suppkey AND li.rn = w.rn + 1)
SELECT li.l_suppkey, li.l_orderkey, li.l_linenumber, li.l_partkey, walk.admitted
FROM walk JOIN li USING (l_suppkey, rn)""")
def byte_budget_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import byte_budget
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                                                      "l_quantity")
    # item order must be total: (order, line, part) is unique per supplier
    out = byte_budget(li, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity",
                      max_asset=BUDGET_MAX_ASSET, max_total=BUDGET_MAX_TOTAL)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "admitted")


# ---------------------------------------------------------------------------
# W3 per-host politeness schedule of the discovered links
# ---------------------------------------------------------------------------

@register("host_schedule", "WITH " + PAGES_NORM_SQL + r""",
t AS (SELECT page_id, netloc, regexp_extract_all(html, '<a\s[^>]*>', 0) AS tags FROM pc),
e AS (SELECT page_id, netloc, unnest(range(len(tags))) AS pos, unnest(tags) AS tag FROM t),
h AS (SELECT page_id, pos, netloc, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
             lower(regexp_extract(substr(regexp_extract(tag, 'href="([^"]*)"', 1), 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext
      FROM e),
k AS (SELECT page_id, pos, netloc AS host FROM h
      WHERE href LIKE '/%' AND NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r""")))
SELECT page_id, pos, host, n, greatest(0.0, (n + 1 - 20) / 10.0) AS start_at
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id, pos) - 1 AS n FROM k)""")
def host_schedule_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.policy import host_schedule
    links = X.extract_links(X.with_tokens(X.corpus(read_pages(spark, sf_dir))), base_col="norm_url")
    req = links.select("page_id", "pos", U.authority("abs_url").alias("host"))
    return host_schedule(req, ["page_id", "pos"]).select("page_id", "pos", "host", "n", "start_at")


# ---------------------------------------------------------------------------
# U9/J4/P4 private addresses
# ---------------------------------------------------------------------------

@register("private_hosts", r"""
SELECT event_id,
       CASE event_id % 4 WHEN 0 THEN 'http://10.0.' || (event_id % 256) || '.1/'
                         WHEN 1 THEN 'http://8.8.' || (event_id % 256) || '.8/'
                         WHEN 2 THEN 'http://172.' || (event_id % 32 + 16) || '.0.1:8080/x'
                         ELSE 'https://Name' || event_id || '.example.com/p' END AS url,
       CASE event_id % 4 WHEN 0 THEN '10.0.' || (event_id % 256) || '.1'
                         WHEN 1 THEN '8.8.' || (event_id % 256) || '.8'
                         WHEN 2 THEN '172.' || (event_id % 32 + 16) || '.0.1'
                         ELSE 'name' || event_id || '.example.com' END AS host,
       CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN event_id % 32 < 16
                         ELSE event_id % 3 <> 0 AND event_id % 2 = 0 END AS is_private
FROM events""")
def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.policy import block_private
    from ..sources.tables import read_table
    urls, dns = derived.host_mix(read_table(spark, sf_dir, "events").select("event_id"))
    return block_private(urls, "url", dns).select("event_id", "url", "host", "is_private")


# ---------------------------------------------------------------------------
# T1/W4/U13 job status (batch and streaming), T2 live jobs
# ---------------------------------------------------------------------------

_JOBS_SQL = r"""
WITH e AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id,
                  event_type IN ('view', 'click', 'signup') AS prog FROM events),
a AS (SELECT job_id,
             CAST(count(*) FILTER (WHERE prog) AS INTEGER) AS pages_cloned,
             arg_max('https://site.example.com/p/' || event_id, (ts, event_id)) FILTER (WHERE prog) AS cu,
             arg_max(CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END, (ts, event_id))
                 FILTER (WHERE NOT prog) AS st,
             arg_max('HTTP error ' || event_id, (ts, event_id)) FILTER (WHERE event_type = 'error') AS err,
             arg_max('cloned_sites/' || job_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS od
      FROM e GROUP BY job_id)
SELECT job_id, coalesce(st, 'running') AS status, pages_cloned, 100 AS max_pages,
       coalesce(cu, '') AS current_url, coalesce(od, '') AS output_dir, err AS error,
       CASE WHEN coalesce(st, 'running') = 'done' THEN 100
            ELSE CAST(floor(pages_cloned / 100 * 100 + 0.5) AS INTEGER) END AS progress
FROM a"""

_JOB_COLS = ["job_id", "status", "pages_cloned", "max_pages", "current_url", "output_dir", "error", "progress"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import read_table
    return read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@register("job_status", _JOBS_SQL)
def job_status_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.jobs import job_patches_from_events, job_status
    return job_status(job_patches_from_events(_events(spark, sf_dir))).select(*_JOB_COLS)


@register("job_status_stream", _JOBS_SQL)
def job_status_stream_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches (a table of several files) as a stream, in update mode."""
    from ..operators.jobs import job_patches_from_events
    from ..session import scratch_path
    from ..streaming.live import job_status_stream, job_table, run_available
    path = scratch_path(spark, "patches")
    job_patches_from_events(_events(spark, sf_dir)).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    return job_table(run_available(job_status_stream(stream), "jobs", mode="update")).select(*_JOB_COLS)


JOBS_NOW = "2024-01-15 12:00:00"
JOBS_TTL = 86400


@register("live_jobs", r"""
SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS job_id,
       round(epoch_us(min(ts)) / 1e6, 3) AS created_s
FROM events GROUP BY 1
HAVING min(ts) >= TIMESTAMP '""" + JOBS_NOW + r"""' - INTERVAL """ + f"'{JOBS_TTL} seconds'")
def live_jobs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.jobs import job_patches_from_events, job_status, live_jobs
    jobs = job_status(job_patches_from_events(_events(spark, sf_dir)))
    return live_jobs(jobs, JOBS_NOW, JOBS_TTL).select(
        "job_id", F.round(F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6, 3).alias("created_s"))


# ---------------------------------------------------------------------------
# R1/J6 re-crawl change classes
# ---------------------------------------------------------------------------

@register("recrawl_diff", r"""
SELECT 'doc://' || doc_id AS url,
       CASE WHEN doc_id % 10 = 0 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS change,
       CASE doc_id % 3 WHEN 0 THEN 'If-None-Match: ' || md5(text) WHEN 1 THEN 'If-Modified-Since: v1' END AS request_header
FROM documents
UNION ALL
SELECT 'doc://' || (doc_id + 100000000), 'new', NULL FROM documents WHERE doc_id % 10 = 5""")
def recrawl_diff_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from ..operators.snapshot import recrawl_diff
    from ..sources.tables import read_table
    old, new = derived.document_snapshots(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return recrawl_diff(old, new)


# ---------------------------------------------------------------------------
# T3 streaming frontier, T4 token bucket stream
# ---------------------------------------------------------------------------

@register("stream_frontier", "WITH " + PAGES_NORM_SQL + r""",
t AS (SELECT scheme, netloc, unnest(regexp_extract_all(html, '<a\s[^>]*>', 0)) AS tag FROM pn),
h AS (SELECT scheme, netloc, regexp_extract(tag, 'href="([^"]*)"', 1) AS href FROM t),
r AS (SELECT scheme || '://' || netloc || href AS norm_url, netloc AS host,
             lower(regexp_extract(substr(href, 2), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext
      FROM h WHERE href LIKE '/%')
SELECT DISTINCT norm_url, host FROM r
WHERE NOT (ext IN (""" + KNOWN_SQL + r""") AND ext NOT IN (""" + PAGE_SQL + r"""))""")
def stream_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.live import read_table_stream, run_available, streaming_frontier
    stream = read_table_stream(spark, sf_dir, "pages").select("page_id", "url", "html")
    return run_available(streaming_frontier(stream), "frontier").drop("epoch")


@register("token_bucket_stream", r"""
WITH e AS (SELECT event_id, 'h' || (user_id % 5) AS host, epoch_us(ts) / 1e6 AS arrival FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY arrival, event_id) - 1 AS n FROM e),
s AS (SELECT *, greatest(arrival, (n - 19) / 10.0 + max(arrival - n / 10.0) OVER (
        PARTITION BY host ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS start_at FROM n)
SELECT event_id, host, round(arrival, 6) AS arrival, round(start_at, 3) AS start_at, round(start_at - arrival, 3) AS wait_s
FROM s""")
def token_bucket_stream_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-host token bucket over request arrivals (events: host = user_id % 5,
    arrival = ts)."""
    from ..streaming.live import read_table_stream, token_bucket_stream
    ev = read_table_stream(spark, sf_dir, "events")
    req = ev.select("event_id", F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"))
    return token_bucket_stream(req, "bucket").select("event_id", "host", *[
        F.round(c, k).alias(c) for c, k in (("arrival", 6), ("start_at", 3), ("wait_s", 3))])


# ---------------------------------------------------------------------------
# C1 clone_site -> S6/S7 manifest, W5 last writer, A4 totals, S8 progress,
# F1 hook; J7/A2 download plan
# ---------------------------------------------------------------------------

_SITE_FILES_SQL = r"""
WITH RECURSIVE r(id, lvl) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION ALL
  SELECT c.page_id, r.lvl + 1 FROM r JOIN pages c ON c.page_id = 2 * r.id + 1 OR c.page_id = 2 * r.id + 2
  WHERE NOT starts_with(CAST(c.page_id AS VARCHAR), '7')),
c AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rk FROM r) WHERE rk <= """ + str(100) + r"""),
pf AS (SELECT 'p/' || id || '.html' AS local_path, 'page' AS kind,
              '<html><head><title>p' || id || '</title>'
              || CASE WHEN id % 10 = 0 THEN '<meta http-equiv="refresh" content="0; url=/news/' || id || '">'
                      ELSE '' END
              || '</head><body><a href="p/' || (2 * id + 1) || '.html">left</a> <a href="p/' || (2 * id + 2)
              || '.html">right</a> <a href="p/0.html">home</a></body></html>'
              || '<img src="img/' || (id % 3) || '.png"><link rel="stylesheet" href="css/site.css">' AS content
       FROM c),
af AS (SELECT DISTINCT 'img/' || (id % 3) || '.png' AS local_path, 'asset' AS kind, 'PNG' || (id % 3) AS content
       FROM c
       UNION ALL SELECT 'css/site.css', 'asset', 'body{background:url("css/bg.png")}'
       UNION ALL SELECT 'css/bg.png', 'asset', 'BG'),
f AS (SELECT * FROM pf UNION ALL SELECT * FROM af)"""


def _clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from .clone import Hooks, clone_site
    from ..config import CrawlConfig
    from ..operators.robots import parse_robots
    pages = read_pages(spark, sf_dir)
    site = derived.link_graph_site(pages)
    seeds = spark.createDataFrame([("site", derived.SITE + "/p/0")], "crawl_id string, url string")
    robots = parse_robots(spark.createDataFrame([derived.site_robots()], "host string, status int, body string"))
    return clone_site(site, seeds, CrawlConfig(max_pages=CRAWL_MAX_PAGES), responses=derived.site_responses(pages),
                      robots=robots, hooks=Hooks(after_html=derived.site_asset_hook))


@register("site_manifest", _SITE_FILES_SQL + r"""
SELECT 'site' AS crawl_id, local_path, kind, CAST(strlen(content) AS BIGINT) AS size, md5(content) AS md5 FROM f""")
def site_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.snapshot import manifest
    return manifest(_clone(spark, sf_dir)).select("crawl_id", "local_path", "kind", "size", "md5")


@register("site_totals", _SITE_FILES_SQL + r"""
SELECT 'site' AS crawl_id, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM f""")
def site_totals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.snapshot import site_totals
    return site_totals(_clone(spark, sf_dir))


@register("progress_log", r"""
WITH RECURSIVE r(id, lvl) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION ALL
  SELECT c.page_id, r.lvl + 1 FROM r JOIN pages c ON c.page_id = 2 * r.id + 1 OR c.page_id = 2 * r.id + 2
  WHERE NOT starts_with(CAST(c.page_id AS VARCHAR), '7'))
SELECT 'site' AS crawl_id, pages_cloned, """ + str(CRAWL_MAX_PAGES) + r""" AS max_pages,
       'https://site.example.com/p/' || id AS current_url,
       CAST(floor(pages_cloned / """ + str(CRAWL_MAX_PAGES) + r""" * 100 + 0.5) AS INTEGER) AS progress
FROM (SELECT id, row_number() OVER (ORDER BY id) AS pages_cloned FROM r)
WHERE pages_cloned <= """ + str(CRAWL_MAX_PAGES))
def progress_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from .clone import progress_log
    from .crawl import crawl
    from ..config import CrawlConfig
    from ..operators.robots import parse_robots
    site = derived.link_graph_site(read_pages(spark, sf_dir))
    seeds = spark.createDataFrame([("site", derived.SITE + "/p/0")], "crawl_id string, url string")
    robots = parse_robots(spark.createDataFrame([derived.site_robots()], "host string, status int, body string"))
    got = crawl(site, seeds, CrawlConfig(max_pages=CRAWL_MAX_PAGES), robots=robots)
    return progress_log(got, CRAWL_MAX_PAGES).withColumn(
        "progress", U.progress_pct("pages_cloned", "max_pages"))


@register("download_plan", "WITH " + _ORIGIN_SQL + r"""
SELECT page_id, abs_url, content_type FROM (
  SELECT page_id, origin || '/img/' || (page_id % 7) || '.png' AS abs_url, NULL AS content_type FROM o
  UNION ALL SELECT page_id, origin || '/s/' || page_id || '.jpg', NULL FROM o
  UNION ALL SELECT page_id, origin || '/l/' || page_id || '.jpg', NULL FROM o
  UNION ALL SELECT page_id, origin || '/js/' || (page_id % 5), 'application/javascript' FROM o)
WHERE abs_url NOT IN (SELECT origin || '/img/' || (page_id % 7) || '.png' FROM o WHERE page_id % 2 = 0)""")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, distinct asset URLs with their first hint, minus the
    URLs already downloaded (stylesheets, and every image URL that an even
    page uses)."""
    from ..operators.snapshot import plan_downloads
    assets = X.extract_assets(X.with_tokens(_markup_pages(spark, sf_dir)))
    have = (assets.where((F.col("page_id") % 2 == 0) & (F.col("tag") == "img") & (F.col("attr") == "src"))
            .select(F.col("abs_url").alias("url"))
            .unionByName(assets.where(F.col("tag") == "link").select(F.col("abs_url").alias("url"))))
    plan = plan_downloads(assets.withColumn("crawl_rank", F.lit(0)), snapshot=have, keys=["page_id"])
    return plan.select("page_id", "abs_url", "content_type")


# ---------------------------------------------------------------------------
# A5 crawl counters where the crawl stops
# ---------------------------------------------------------------------------

@register("crawl_counts", r"""
WITH RECURSIVE r(id, lvl) AS (
  SELECT page_id, 0 FROM pages WHERE page_id = 0
  UNION ALL
  SELECT c.page_id, r.lvl + 1 FROM r JOIN pages c ON c.page_id = 2 * r.id + 1 OR c.page_id = 2 * r.id + 2
  WHERE NOT starts_with(CAST(c.page_id AS VARCHAR), '7')),
f AS (SELECT id, lvl FROM (SELECT id, lvl, row_number() OVER (ORDER BY id) AS rk FROM r)
      WHERE rk <= """ + str(CRAWL_MAX_PAGES) + r"""),
e AS (SELECT lvl + 1 AS lvl, id AS parent, 0 AS pos FROM f
      UNION ALL SELECT lvl + 1, id, 1 FROM f
      UNION ALL SELECT lvl + 1, id, -1 FROM f WHERE id % 10 = 0),
lp AS (SELECT (id - 1) // 2 AS parent, CASE WHEN id % 2 = 1 THEN 0 ELSE 1 END AS pos, lvl
       FROM f ORDER BY id DESC LIMIT 1)
SELECT 'site' AS crawl_id, (SELECT count(*) FROM f) AS pages_cloned, 1 + (SELECT count(*) FROM e) AS visited,
       CASE WHEN (SELECT count(*) FROM f) < """ + str(CRAWL_MAX_PAGES) + r""" THEN 0 ELSE
         (SELECT count(*) FROM e, lp
          WHERE (e.lvl = lp.lvl AND (e.parent > lp.parent OR (e.parent = lp.parent AND e.pos > lp.pos)))
             OR e.lvl = lp.lvl + 1) END AS queue_len,
       0 AS sitemap_urls""")
def crawl_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import derived
    from .crawl import crawl_with_counts
    from ..config import CrawlConfig
    from ..operators.robots import parse_robots
    site = derived.link_graph_site(read_pages(spark, sf_dir))
    seeds = spark.createDataFrame([("site", derived.SITE + "/p/0")], "crawl_id string, url string")
    robots = parse_robots(spark.createDataFrame([derived.site_robots()], "host string, status int, body string"))
    return crawl_with_counts(site, seeds, CrawlConfig(max_pages=CRAWL_MAX_PAGES), robots=robots)[1]
