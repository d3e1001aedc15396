"""Crawl scenarios of the original test suite (mocked site -> corpus rows)
plus random graphs against a queue-based reference crawl."""
import random
from collections import deque
from urllib.parse import urljoin, urlsplit

import pytest

from mirrorframe.config import CrawlConfig
from mirrorframe.plans.crawl import crawl, expand_sitemaps
from mirrorframe.operators.robots import parse_robots


def make_html(links=(), body=""):
    tags = "\n".join(f'<a href="{x}">{x}</a>' for x in links)
    return f"<html><head></head><body>{body}\n{tags}</body></html>"


def run(spark, site, seed="http://example.com", max_pages=5, follow=False, robots=None):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", seed)], "crawl_id string, url string")
    rb = None
    if robots is not None:
        rb = parse_robots(spark.createDataFrame(robots, "host string, status int, body string"))
    out = crawl(pages, seeds, CrawlConfig(max_pages=max_pages, follow_domains=follow), robots=rb)
    return [r.norm_url for r in out.orderBy("crawl_rank").collect()]


def test_seed_first_and_follow(spark):
    got = run(spark, {"http://example.com/": make_html(["/about", "/contact"]),
                      "http://example.com/about": make_html(), "http://example.com/contact": make_html()})
    assert got == ["http://example.com/", "http://example.com/about", "http://example.com/contact"]


def test_max_pages_and_no_revisit(spark):
    assert run(spark, {"http://example.com/": make_html(["/about", "/contact"])}, max_pages=1) == [
        "http://example.com/"]
    got = run(spark, {"http://example.com/": make_html(["/about", "/about"]),
                      "http://example.com/about": make_html(["/"])})
    assert got == ["http://example.com/", "http://example.com/about"]


def test_external_links(spark):
    site = {"http://example.com/": make_html(["http://other.com/page"]), "http://other.com/page": make_html()}
    assert run(spark, site) == ["http://example.com/"]
    assert run(spark, site, follow=True) == ["http://example.com/", "http://other.com/page"]


def test_robots(spark):
    site = {"http://example.com/": make_html(["/secret/page1", "/about"]),
            "http://example.com/about": make_html(), "http://example.com/secret/page1": make_html()}
    got = run(spark, site, max_pages=10, robots=[("example.com", 200, "User-agent: *\nDisallow: /secret/\n")])
    assert got == ["http://example.com/", "http://example.com/about"]
    # deny all: seed still fetched
    got = run(spark, site, max_pages=10, robots=[("example.com", 403, "")])
    assert got == ["http://example.com/"]
    # 404 robots: everything allowed
    got = run(spark, site, max_pages=10, robots=[("example.com", 404, "")])
    assert len(got) == 3


def test_cap_mid_crawl(spark):
    site = {"http://example.com/": make_html(["/page1", "/page2"]),
            "http://example.com/page1": make_html(["/page3"]), "http://example.com/page2": make_html(),
            "http://example.com/page3": make_html()}
    assert run(spark, site, max_pages=2) == ["http://example.com/", "http://example.com/page1"]


def queue_crawl(site, seed, max_pages, disallow=()):
    """First in, first out over a site whose URLs are all in normal form:
    (pages in order, URLs ever queued, URLs still queued)."""
    import re
    queue, known, out = deque([seed]), {seed}, []
    while queue and len(out) < max_pages:
        url = queue.popleft()
        blocked = url != seed and urlsplit(url).path.startswith(tuple(disallow) or ("\0",))
        if blocked or url not in site:
            continue
        out.append(url)
        refresh = re.findall(r'content="0; url=([^"]+)"', site[url])
        for target in refresh + re.findall(r'<a href="([^"]*)"', site[url]):
            absolute = urljoin(url, target)
            if absolute not in known:
                known.add(absolute)
                queue.append(absolute)
    return out, known, queue


@pytest.mark.parametrize("seed_val", [3, 11])
def test_random_graph_matches_queue(spark, seed_val):
    rnd = random.Random(seed_val)
    n = 40
    site = {}
    for i in range(n):
        if rnd.random() < 0.1 and i:
            continue  # missing page
        links = [f"/n/{rnd.randrange(n + 5)}" for _ in range(rnd.randrange(4))]
        body = f'<meta http-equiv="refresh" content="0; url=/n/{rnd.randrange(n)}">' if rnd.random() < 0.1 else ""
        site[f"http://g.com/n/{i}"] = make_html(links, body)
    site["http://g.com/n/0"] = make_html([f"/n/{k}" for k in range(1, 6)])
    robots = [("g.com", 200, "User-agent: *\nDisallow: /n/1\n")]
    want, _, _ = queue_crawl(site, "http://g.com/n/0", 15, disallow=("/n/1",))
    got = run(spark, site, seed="http://g.com/n/0", max_pages=15, robots=robots)
    assert got == want


def test_sitemap_depth_and_failures(spark):
    docs = [("http://s.com/sitemap.xml", 200, "application/xml",
             "<sitemapindex><sitemap><loc>http://s.com/a.xml</loc></sitemap>"
             "<sitemap><loc>http://s.com/bad.xml</loc></sitemap></sitemapindex>"),
            ("http://s.com/a.xml", 200, "text/xml", "<sitemapindex><sitemap><loc>http://s.com/b.xml</loc>"
             "</sitemap></sitemapindex>"),
            ("http://s.com/b.xml", 200, "text/xml", "<sitemapindex><sitemap><loc>http://s.com/c.xml</loc>"
             "</sitemap></sitemapindex>"),
            ("http://s.com/c.xml", 200, "text/xml", "<sitemapindex><sitemap><loc>http://s.com/d.xml</loc>"
             "</sitemap></sitemapindex>"),
            ("http://s.com/d.xml", 200, "text/xml", "<urlset><url><loc>http://s.com/deep</loc></url></urlset>"),
            ("http://s.com/bad.xml", 200, "text/html", "<urlset><url><loc>http://s.com/x</loc></url></urlset>"),
            ("http://t.com/sitemap.xml", 200, "application/xml",
             "<urlset><url><loc> http://t.com/a&amp;b </loc></url><url><loc></loc></url></urlset>")]
    sm = spark.createDataFrame(docs, "url string, status int, content_type string, body string")
    roots = spark.createDataFrame([("1", "http://s.com/sitemap.xml"), ("2", "http://t.com/sitemap.xml")],
                                  "crawl_id string, url string")
    got = sorted((r.crawl_id, r.loc) for r in expand_sitemaps(roots, sm).collect())
    # depth 0..3 are read; d.xml would be depth 4 -> nothing; bad content type -> nothing
    assert got == [("2", "http://t.com/a&b")]


def test_sitemap_seeds_come_after_seed_without_scope(spark):
    """Seed first, then sitemap URLs (normalised, deduped, no scope test),
    then the seed's links."""
    site = {"http://example.com/": make_html(["/a"]), "http://example.com/a": make_html(),
            "http://example.com/s1": make_html(), "http://other.com/s2": make_html()}
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://example.com")], "crawl_id string, url string")
    sm = spark.createDataFrame([("c", "http://example.com/s1/", [0]), ("c", "http://other.com/s2#x", [1]),
                                ("c", "http://example.com/", [2])], "crawl_id string, loc string, ord array<int>")
    out = crawl(pages, seeds, CrawlConfig(max_pages=10), sitemap_urls=sm)
    got = [r.norm_url for r in out.orderBy("crawl_rank").collect()]
    assert got == ["http://example.com/", "http://example.com/s1", "http://other.com/s2", "http://example.com/a"]


def test_clone_hooks(spark):
    """F1 after_html, F2 map_url and F3 export are applied."""
    from pyspark.sql import functions as F
    from mirrorframe.plans.clone import Hooks, clone_site
    site = {"http://example.com/": '<img src="/i.png"><a href="/b">b</a>', "http://example.com/b": "<p>b</p>"}
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://example.com/")], "crawl_id string, url string")
    resp = spark.createDataFrame([("http://cdn.example.com/i.png", 200, "image/png", bytearray(b"PNG"), 3)],
                                 "url string, status int, content_type string, body binary, size long")
    seen = []
    hooks = Hooks(after_html=lambda url, html: F.concat(html, F.lit("<!--x-->")),
                  map_url=lambda u: F.regexp_replace(u, r"^http://example.com/(.*\.png)$", "http://cdn.example.com/$1"),
                  export=lambda files: seen.append(files.count()))
    files = {r.local_path: bytes(r.content) for r in clone_site(pages, seeds, responses=resp, hooks=hooks).collect()}
    assert files["i.png"] == b"PNG"
    assert files["index.html"].endswith(b"<!--x-->")
    assert b'href="b.html"' in files["index.html"]
    assert b'<img src="i.png">' in files["index.html"]
    assert seen == [3]


def test_crawl_counts_match_queue(spark):
    """A5: pages cloned, visited and queue length where a queue crawl stops."""
    from mirrorframe.plans.crawl import crawl_with_counts
    rnd = random.Random(5)
    site = {}
    for i in range(30):
        site[f"http://g.com/n/{i}"] = make_html([f"/n/{rnd.randrange(40)}" for _ in range(3)])
    site["http://g.com/n/0"] = make_html([f"/n/{k}" for k in range(1, 5)])
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://g.com/n/0")], "crawl_id string, url string")
    for cap in (7, 100):
        _, counts = crawl_with_counts(pages, seeds, CrawlConfig(max_pages=cap))
        c = counts.first()
        out, known, queue = queue_crawl(site, "http://g.com/n/0", cap)
        assert (c.pages_cloned, c.visited, c.queue_len) == (len(out), len(known), len(queue))


def test_private_hosts_are_not_fetched(spark):
    site = {"http://example.com/": make_html(["http://10.0.0.1/a", "http://inner.example/b", "http://ok.example/c"]),
            "http://10.0.0.1/a": make_html(), "http://inner.example/b": make_html(), "http://ok.example/c": make_html()}
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://example.com/")], "crawl_id string, url string")
    dns = spark.createDataFrame([("inner.example", "192.168.1.4"), ("ok.example", "93.184.216.34")],
                                "host string, ip string")
    for block, n in ((True, 2), (False, 4)):
        out = crawl(pages, seeds, CrawlConfig(follow_domains=True, block_private=block), dns=dns)
        assert out.count() == n


def test_deep_chain_is_walked_to_its_end(spark):
    """More levels than visited tables are kept apart."""
    site = {f"http://g.com/n/{i}": make_html([f"/n/{i + 1}"]) for i in range(14)}
    assert run(spark, site, seed="http://g.com/n/0", max_pages=100) == list(site)


def test_sitemap_comments_and_cdata(spark):
    doc = ("<urlset><!-- <url><loc>http://s.com/no</loc></url> --><url><loc><![CDATA[http://s.com/a]]></loc></url></urlset>")
    sm = spark.createDataFrame([("http://s.com/sitemap.xml", 200, "text/xml", doc)],
                               "url string, status int, content_type string, body string")
    roots = spark.createDataFrame([("1", "http://s.com/sitemap.xml")], "crawl_id string, url string")
    assert [r.loc for r in expand_sitemaps(roots, sm).collect()] == ["http://s.com/a"]


def _clone(spark, site, responses, **cfg):
    from mirrorframe.plans.clone import clone_site
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())],
                                  "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://example.com/")], "crawl_id string, url string")
    resp = spark.createDataFrame([(u, s, "x/y", bytearray(b), len(b), k) for k, (u, s, b) in enumerate(responses)],
                                 "url string, status int, content_type string, body binary, size long, attempt int")
    return {r.local_path: bytes(r.content) for r in clone_site(pages, seeds, CrawlConfig(**cfg), responses=resp).collect()}


def test_clone_takes_the_latest_answer_and_last_writer(spark):
    site = {"http://example.com/": '<img src="/a.png?1"><img src="/a.png?2"><img src="http://127.0.0.1/x.png"><img src="ftp://h/y.png">'}
    e = "http://example.com"
    files = _clone(spark, site, [(e + "/a.png?1", 500, b"old"), (e + "/a.png?1", 200, b"one"), (e + "/a.png?1", 200, b"newer"),
                                 (e + "/a.png?2", 200, b"two"), ("http://127.0.0.1/x.png", 200, b"in"), ("ftp://h/y.png", 200, b"f")])
    assert files.pop("index.html").count(b'src="a.png"') == 2
    assert files == {"a.png": b"two"}


def test_clone_counts_sheet_files_in_the_budget(spark):
    site = {"http://example.com/": '<link rel="stylesheet" href="/s.css"><img src="/z.png">'}
    e = "http://example.com"
    css = b"a{background:url(big.png)} b{background:url(small.png)}"
    answers = [(e + "/s.css", 200, css), (e + "/big.png", 200, b"B" * 60), (e + "/small.png", 200, b"S" * 5),
               (e + "/z.png", 200, b"Z" * 30)]
    # images of the page come before its stylesheet; the sheet's files share what is left
    files = _clone(spark, site, answers, max_total_bytes=len(css) + 36)
    assert sorted(files) == ["index.html", "s.css", "small.png", "z.png"]
    files = _clone(spark, site, answers, max_total_bytes=40)  # the sheet is not stored: its files are not either
    assert sorted(files) == ["index.html", "z.png"]
    files = _clone(spark, site, answers, max_asset_size=58)
    assert sorted(files) == ["index.html", "s.css", "small.png", "z.png"]


def test_one_path_for_a_url_met_as_script_and_link(spark):
    site = {"http://example.com/": '<script src="/app"></script><a href="/app">x</a>', "http://example.com/app": "<p>page</p>"}
    files = _clone(spark, site, [("http://example.com/app", 200, b"code")])
    assert set(files) == {"index.html", "app.js"}
    assert files["index.html"] == b'<script src="app.js"></script><a href="app.js">x</a>'
    assert files["app.js"] == b"<p>page</p>"  # the page is written last


def test_deep_crawl_keeps_queue_order(spark, monkeypatch):
    """``ord`` starts again from the rank every few levels, and the order stays that of the queue."""
    from mirrorframe.plans import crawl as plan
    monkeypatch.setattr(plan, "RANK_LEVELS", 3)
    site = {f"http://g.com/n/{i}": make_html([f"/n/{i + 3}", f"/n/{i + 2}", f"/n/{i // 2}"]) for i in range(24)}
    want, _, _ = queue_crawl(site, "http://g.com/n/0", 22)
    assert run(spark, site, seed="http://g.com/n/0", max_pages=22) == want
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(site.items())], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://g.com/n/0")], "crawl_id string, url string")
    rows = crawl(pages, seeds, CrawlConfig(max_pages=100)).collect()
    assert len(rows) == 24 and max(r.level for r in rows) > 6 and max(len(r.ord) for r in rows) <= 4


def test_strict_scope(spark):
    """A meta refresh and sitemap URLs are followed anywhere, or with ``strict_scope`` as links are."""
    pages = spark.createDataFrame([
        (1, "http://a.com/", '<meta http-equiv="refresh" content="0; url=http://b.com/x">'),
        (2, "http://b.com/x", ""), (3, "http://b.com/y", ""),
        (4, "http://a.com/z", '<meta http-equiv="refresh" content="0; url=/w.png">'), (5, "http://a.com/w.png", ""),
        (6, "http://a.com/v.pdf", "")], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", "http://a.com/")], "crawl_id string, url string")
    listed = spark.createDataFrame([("c", f"http://{u}", [i]) for i, u in enumerate(["b.com/y", "a.com/z", "a.com/v.pdf"])],
                                   "crawl_id string, loc string, ord array<int>")
    def got(**options):
        return sorted(r.page_id for r in crawl(pages, seeds, CrawlConfig(**options), sitemap_urls=listed).collect())
    assert got() == [1, 2, 3, 4, 5, 6]
    assert got(strict_scope=True) == [1, 4]
    assert got(strict_scope=True, follow_domains=True) == [1, 2, 3, 4]
