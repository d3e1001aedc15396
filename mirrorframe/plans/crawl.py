"""Breadth-first crawl over a fetched corpus (I1 with J1, J2, A1, X1, L1, P3,
P4) and sitemap expansion (I2, S4, L2).

One pass over the corpus reads the links of every page into a narrow edge
table; the crawl then joins keys only, level by level, and html is joined once
at the end, for the pages that were chosen.  Every URL carries ``ord`` = its
parent's ``ord`` followed by its position on the parent page (seed ``[0]``,
sitemap URLs ``[1..n]``, meta refresh position -1).  Within one level all keys
have the same length, so ordering by ``ord`` is exactly the FIFO order of a
queue-based crawl; first discovery is ``min(ord)``.  After ``RANK_LEVELS``
levels the paths of a level give way to their ranks, so that ``ord`` does not
grow with the depth.  Each level is a table in the shared folder, so lineage
stays short and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITEMAP_MAX_DEPTH, CrawlConfig
from ..functions import html as H
from ..functions import urls as U
from ..operators import extract as X
from ..operators.policy import block_private, prefix_sum
from ..operators.robots import robots_filter
from ..session import Scratch, checkpoint_root

#: Levels after which the list of visited URLs is written as one table again.
MERGE_LEVELS = 8

#: Levels after which ``ord`` starts again from the rank within the level.
RANK_LEVELS = 16


def ranked_ord(frontier: DataFrame) -> DataFrame:
    """``frontier(crawl_id, norm_url, ord)`` with ``ord`` replaced by its rank in the crawl, as two numbers that order alike."""
    ranked = prefix_sum(frontier, ["crawl_id"], ["ord", "norm_url"], out="_rank")
    high, low = F.shiftright("_rank", 30), F.col("_rank").bitwiseAND(F.lit((1 << 30) - 1))
    return ranked.select("crawl_id", "norm_url", F.array(high.cast("int"), low.cast("int")).alias("ord"))


def edge_table(corpus: DataFrame, map_url: Callable[[Column], Column] | None = None) -> DataFrame:
    """Links and meta refreshes of every page: ``(norm_url, pos, target,
    netloc, any_scope)``.  A meta refresh comes first (position -1) and is
    followed whatever its domain."""
    tok = X.with_tokens(corpus.select("norm_url", "html"))
    links = F.transform(X.link_rows("tokens", "norm_url", None, True), lambda r: F.struct(
        r["pos"].cast("int").alias("pos"), r["abs_url"].alias("abs_url"), F.lit(False).alias("any_scope")))
    refresh = F.transform(X.refresh_rows("tokens", "norm_url"), lambda r: F.struct(
        r["pos"].cast("int").alias("pos"), r["abs_url"].alias("abs_url"), F.lit(True).alias("any_scope")))
    rows = tok.select("norm_url", F.inline(F.concat(refresh, links)))
    mapped = map_url(F.col("abs_url")) if map_url else F.col("abs_url")
    target = F.transform(F.array(U.normalize_url(mapped)), lambda t: F.struct(
        t.alias("target"), U.authority(t).alias("netloc")))
    return rows.select("norm_url", "pos", "any_scope", F.inline(target))


def crawl(pages: DataFrame, seeds: DataFrame, cfg: CrawlConfig | None = None,
          robots: DataFrame | None = None, sitemap_urls: DataFrame | None = None,
          keep_html: bool = False, dns: DataFrame | None = None,
          map_url: Callable[[Column], Column] | None = None) -> DataFrame:
    """See ``crawl_with_counts``; returns only the fetched pages."""
    return crawl_with_counts(pages, seeds, cfg, robots, sitemap_urls, keep_html, dns, map_url)[0]


def crawl_with_counts(pages: DataFrame, seeds: DataFrame, cfg: CrawlConfig | None = None,
                      robots: DataFrame | None = None, sitemap_urls: DataFrame | None = None,
                      keep_html: bool = False, dns: DataFrame | None = None,
                      map_url: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Crawl many seeds at once.

    ``seeds(crawl_id, url)``; ``pages(page_id, url, html)`` is the corpus
    (``fetch`` = join by normalised URL; a missing URL is a failed fetch and
    does not count toward ``max_pages``, nor does a page on a private host);
    ``robots(host, line_no, allow, prefix)``, ``sitemap_urls(crawl_id, loc,
    ord)`` and ``dns(host, ip)`` are optional; ``map_url`` maps every URL
    discovered on a page.  With ``strict_scope`` meta refreshes and sitemap
    URLs pass the tests of links; the seed never has to.

    Returns the fetched pages ``(crawl_id, norm_url, page_id, level, ord,
    crawl_rank)`` (+ ``url, html, seed_url`` when ``keep_html``) and A5
    counts ``(crawl_id, pages_cloned, visited, queue_len, sitemap_urls)`` at
    the point the crawl stops (queue = enqueued but not yet dequeued)."""
    cfg = cfg or CrawlConfig()
    spark = seeds.sparkSession
    checkpoint_root(spark)
    key = ["crawl_id", "norm_url"]
    with Scratch(spark, "crawl") as scratch:
        corpus = X.corpus(pages)
        edges = scratch.table(edge_table(corpus, map_url))
        # A page on a private host is not fetched
        nodes = block_private(corpus.select("norm_url", "page_id"), "norm_url", dns)
        nodes = scratch.table((nodes.where(~F.col("is_private")) if cfg.block_private else nodes)
                              .select("norm_url", "page_id"))
        if robots is not None:
            robots = scratch.table(robots)
        seed_info = scratch.keep(seeds.select(
            F.col("crawl_id").cast("string").alias("crawl_id"), U.normalize_url("url").alias("seed_url"),
            U.authority(U.normalize_url("url")).alias("seed_netloc")))
        level0 = seed_info.select("crawl_id", F.col("seed_url").alias("norm_url"), F.array(F.lit(0)).alias("ord"))
        if sitemap_urls is not None:
            sitemap_urls = scratch.keep(sitemap_urls.select(
                F.col("crawl_id").cast("string").alias("crawl_id"), "loc", "ord"))
            listed = sitemap_urls.select(
                "crawl_id", U.normalize_url("loc").alias("norm_url"), F.concat(F.array(F.lit(1)), "ord").alias("ord"))
            if cfg.strict_scope:
                listed = listed.where(U.is_html_link("norm_url"))
                if not cfg.follow_domains:
                    listed = listed.join(seed_info.select("crawl_id", "seed_netloc"), "crawl_id").where(
                        U.authority("norm_url") == F.col("seed_netloc")).drop("seed_netloc")
            level0 = level0.unionByName(listed)
        frontier = scratch.table(level0.groupBy(*key).agg(F.min("ord").alias("ord")))
        visited = [frontier.select(*key)]
        got_levels, queued = [], []
        cloned = scratch.table(seed_info.select("crawl_id", F.lit(0).cast("long").alias("cloned")))
        level = 0
        while True:
            # Robots at dequeue, seed exempt; J1: fetch = join by normalised URL
            cand = frontier.join(seed_info, "crawl_id")
            if robots is not None:
                cand = robots_filter(cand, robots, exempt_col="seed_url").where("robots_allowed")
            fetched = scratch.table(cand.join(nodes, "norm_url").select(*key, "page_id", "ord", "seed_netloc")
                                    .withColumn("level", F.lit(level)))
            # L1: cap on successful pages.  Ranks are needed only in crawls that pass their cap on this level.
            after = scratch.table(cloned.join(fetched.groupBy("crawl_id").count(), "crawl_id", "left").select(
                "crawl_id", "cloned", (F.col("cloned") + F.coalesce("count", F.lit(0))).alias("then")))
            over = after.where(F.col("then") > cfg.max_pages).select("crawl_id", "cloned")
            got = fetched
            if not over.isEmpty():
                ranked = prefix_sum(fetched.join(over, "crawl_id"), ["crawl_id"], ["ord"], out="_rn")
                got = scratch.table(fetched.join(over, "crawl_id", "left_anti").unionByName(
                    ranked.where(F.col("_rn") + F.col("cloned") <= cfg.max_pages).select(*fetched.columns)))
            got_levels.append(got)
            cloned = after.select("crawl_id", F.least("then", F.lit(cfg.max_pages)).cast("long").alias("cloned"))

            # H2 + H7 of this level's pages -> next frontier (A1 + J2).  Links of
            # every fetched page are enqueued (also on the level that reaches the
            # cap, as a queue crawl does before it stops); only crawls below
            # their cap go on.
            in_scope = F.col("netloc") == F.col("seed_netloc")
            found = got.join(edges, "norm_url")
            if cfg.strict_scope:
                found = found.where(~F.col("any_scope") | U.is_html_link("target"))
            else:
                in_scope = F.col("any_scope") | in_scope
            found = (found if cfg.follow_domains else found.where(in_scope)).select(
                "crawl_id", F.col("target").alias("norm_url"), F.concat("ord", F.array("pos")).alias("ord"))
            if len(visited) > MERGE_LEVELS:
                visited = [scratch.table(reduce(DataFrame.unionByName, visited))]
            enqueued = scratch.table(found.groupBy(*key).agg(F.min("ord").alias("ord")).join(
                reduce(DataFrame.unionByName, visited), key, "left_anti"))
            visited.append(enqueued.select(*key))
            # A5: for crawls reaching the cap on this level, what is still queued:
            # entries of this level behind the last fetched page, plus everything
            # enqueued from this level's pages
            ended = cloned.where(F.col("cloned") >= cfg.max_pages).select("crawl_id")
            last = got.join(ended, "crawl_id").groupBy("crawl_id").agg(F.max("ord").alias("_last"))
            behind = frontier.join(last, "crawl_id").where(F.col("ord") > F.col("_last")).select("crawl_id")
            queued.append(behind.unionByName(enqueued.join(last, "crawl_id").select("crawl_id")))
            frontier = enqueued.join(ended, "crawl_id", "left_anti")
            if frontier.isEmpty():
                break
            level += 1
            if level % RANK_LEVELS == 0:
                frontier = scratch.table(ranked_ord(frontier))

        # The crawl order as a dense number
        out = prefix_sum(reduce(DataFrame.unionByName, got_levels), ["crawl_id"], ["level", "ord"], out="crawl_rank")
        cols = [*key, "page_id", "level", "ord", "crawl_rank"]
        out = scratch.keep(out.select(*cols))
        # A5 counts where the crawl stopped
        n = lambda df, name: df.groupBy("crawl_id").agg(F.count(F.lit(1)).alias(name))
        counts = seed_info.select("crawl_id")
        for part in (n(out, "pages_cloned"), n(reduce(DataFrame.unionByName, visited), "visited"),
                     n(reduce(DataFrame.unionByName, queued), "queue_len"),
                     *([n(sitemap_urls, "sitemap_urls")] if sitemap_urls is not None else [])):
            counts = counts.join(part, "crawl_id", "left")
        names = ["pages_cloned", "visited", "queue_len", "sitemap_urls"]
        counts = scratch.keep(counts.select("crawl_id", *[
            F.coalesce(F.col(c) if c in counts.columns else F.lit(None), F.lit(0)).cast("long").alias(c)
            for c in names]))
    if keep_html:
        out = (out.join(pages.select("page_id", "url", "html"), "page_id")
               .join(seed_info.select("crawl_id", "seed_url"), "crawl_id").select(*cols, "url", "html", "seed_url"))
    return out, counts


# ---------------------------------------------------------------------------
# Sitemaps (S4, I2, L2)
# ---------------------------------------------------------------------------

def _text(x):
    """get_text(strip=True) of a small XML element body."""
    t = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    return F.regexp_replace(H.unescape(t), r"^\s+|\s+$", "")


def expand_sitemaps(roots: DataFrame, sitemaps: DataFrame,
                    max_depth: int = SITEMAP_MAX_DEPTH) -> DataFrame:
    """``roots(crawl_id, url)`` and ``sitemaps(url, status, content_type,
    body)`` -> page URLs ``(crawl_id, loc, ord)`` in document order.

    A document is used only with status 200 and ``xml`` in its content type;
    an index (``<sitemap>`` children) recurses up to ``max_depth`` and its own
    ``<url>`` entries are ignored; a missing document yields nothing.  Comments
    are no content and CDATA sections are text."""
    body = F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    docs = (sitemaps.where((F.col("status") == 200) & F.col("content_type").contains("xml"))
            .select("url", body.alias("body")))
    cur = roots.select(F.col("crawl_id").cast("string").alias("crawl_id"), "url",
                       F.array().cast("array<int>").alias("ord"))
    found = []
    for depth in range(max_depth + 1):
        d = cur.join(docs, "url")
        kids = F.regexp_extract_all("body", F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap\s*>"), 1)
        urls = F.regexp_extract_all("body", F.lit(r"(?is)<url\b[^>]*>(.*?)</url\s*>"), 1)
        loc_of = lambda e: _text(F.regexp_extract(e, r"(?is)<loc\b[^>]*>(.*?)</loc\s*>", 1))
        d = d.select("crawl_id", "ord", kids.alias("kids"), urls.alias("urls"))
        leaf = (d.where(F.size("kids") == 0)
                .select("crawl_id", "ord", F.posexplode(F.transform("urls", loc_of)).alias("i", "loc"))
                .where(F.col("loc") != "")
                .select("crawl_id", "loc", F.concat("ord", F.array(F.col("i").cast("int"))).alias("ord")))
        found.append(leaf)
        cur = (d.where(F.size("kids") > 0)
               .select("crawl_id", "ord", F.posexplode(F.transform("kids", loc_of)).alias("i", "url"))
               .where(F.col("url") != "")
               .select("crawl_id", "url", F.concat("ord", F.array(F.col("i").cast("int"))).alias("ord")))
    return reduce(DataFrame.unionByName, found)
