"""Repeated runs (snapshot upkeep, written sites), path options, stylesheets and the budget that follows them, and streams in
event time, against brute force and hand-made cases."""
import datetime as dt
import posixpath
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorframe.config import CrawlConfig
from mirrorframe.functions import css as C
from mirrorframe.functions import urls as U
from mirrorframe.operators.policy import byte_budget, offered_budget
from mirrorframe.operators.snapshot import (collision_report, conditional_requests, last_writer, latest_answers, merge_snapshot,
                                            path_map, write_site)
from mirrorframe.operators.stylesheets import sheet_closure, sheet_edges
from mirrorframe.plans.clone import clone_run
from mirrorframe.streaming.live import (expiring_jobs, live_job_table, run_available, streaming_frontier, token_bucket_reordered)

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


# --- snapshot -------------------------------------------------------------------------------------------------------------

def _answers(spark, rows):
    """(url, status, body, etag, last_modified, attempt, ts)"""
    df = spark.createDataFrame(rows, "url string, status int, body string, etag string, last_modified string, attempt int, ts timestamp")
    return df.withColumn("body", F.encode("body", "UTF-8")).withColumn("size", F.octet_length("body").cast("long"))


def test_latest_answer_of_a_run(spark):
    got = {r.url: r for r in latest_answers(_answers(spark, [
        ("a", 500, "", None, None, 1, T1), ("a", 200, "x", "e1", "", 2, T1),          # retried
        ("b", 200, "x", "e1", None, 1, T1), ("b", 500, "", None, None, 2, T2),        # a failure after it takes nothing away
        ("c", 404, "", None, None, 1, T1), ("d", 200, "", "e", None, 1, T1), ("e", 200, "too long", None, None, 1, T1),
        ("f", 200, "y", "", "", None, None)]), 5).collect()}
    assert {u: (r.status, r.outcome, r.etag, r.last_modified) for u, r in got.items()} == {
        "a": (200, "accept", "e1", None), "b": (200, "accept", "e1", None), "c": (404, "error", None, None),
        "d": (200, "empty", "e", None), "e": (200, "too_large", None, None), "f": (200, "accept", None, None)}


def test_snapshot_goes_on_from_run_to_run(spark):
    first = merge_snapshot(None, latest_answers(_answers(spark, [
        (u, 200, u, "e-" + u, "m-" + u, 1, T1) for u in ("same", "told", "changed", "again", "lost", "gone", "failing")]
        + [("never", 304, "", None, None, 1, T1), ("missing", 404, "", None, None, 1, T1)]), 1 << 20))
    assert {r.change for r in first.collect()} == {"new"} and first.count() == 7
    answers = latest_answers(_answers(spark, [
        ("same", 304, "", None, None, 1, T2), ("told", 304, "", "e2", None, 1, T2), ("changed", 200, "other", None, "m2", 1, T2),
        ("again", 200, "again", "e3", None, 1, T2), ("gone", 404, "", None, None, 1, T2), ("failing", 503, "", None, None, 1, T2),
        ("extra", 200, "extra", None, None, 1, T2)]), 1 << 20)
    second = merge_snapshot(first, answers, max_missed=1)
    rows = {r.url: (r.etag, r.last_modified, r.size, r.fetched_at, r.missed, r.change) for r in second.collect()}
    assert rows == {
        "same": ("e-same", "m-same", 4, T1, 0, "unchanged"), "told": ("e2", "m-told", 4, T1, 0, "unchanged"),
        "changed": (None, "m2", 5, T2, 0, "changed"), "again": ("e3", None, 5, T2, 0, "unchanged"),
        "lost": ("e-lost", "m-lost", 4, T1, 1, "gone"), "gone": ("e-gone", "m-gone", 4, T1, 1, "gone"),
        "failing": ("e-failing", "m-failing", 7, T1, 0, "kept"), "extra": (None, None, 5, T2, 0, "new")}
    third = merge_snapshot(second, answers.where("url = 'same' OR url = 'gone'"), max_missed=1)
    assert {r.url for r in third.collect()} == {"same", "told", "changed", "again", "failing", "extra"}
    plan = spark.createDataFrame([("same",), ("changed",), ("extra",), ("unknown",)], "abs_url string")
    assert {r.abs_url: r.request_header for r in conditional_requests(plan, second).collect()} == {
        "same": "If-None-Match: e-same", "changed": "If-Modified-Since: m2", "extra": None, "unknown": None}
    assert merge_snapshot(first.limit(0), answers.limit(0)).count() == 0
    # a snapshot of urls alone
    assert merge_snapshot(first.select("url"), answers).where("url = 'same'").first().change == "unchanged"


def test_crawls_written_into_one_path_stay(spark, tmp_path):
    path = str(tmp_path / "site")
    files = lambda crawl, *names: spark.createDataFrame([(crawl, n, crawl + n) for n in names],
                                                        "crawl_id string, local_path string, content string")
    held = lambda: sorted((r.crawl_id, r.local_path) for r in spark.read.parquet(path).collect())
    write_site(files("a", "1", "2"), path)
    write_site(files("b", "1"), path)
    assert held() == [("a", "1"), ("a", "2"), ("b", "1")]
    write_site(files("a", "3"), path)
    assert held() == [("a", "3"), ("b", "1")]
    write_site(files("a", "9").limit(0), path)
    assert held() == [("a", "3"), ("b", "1")]


def test_collisions_name_all_writers(spark):
    files = spark.createDataFrame([("c", "p", "u1", 1), ("c", "p", "u2", 3), ("c", "p", "u2", 2), ("c", "q", "u3", 1), ("c", "q", "u3", 2),
                                   ("d", "p", "u1", 5)], "crawl_id string, local_path string, source_url string, write_seq int")
    got = sorted(map(tuple, collision_report(files).select("crawl_id", "local_path", "source_url", "writers", "won").collect()))
    assert got == [("c", "p", "u1", 2, False), ("c", "p", "u2", 2, True)]
    kept = last_writer(files.withColumn("content", F.lit("x")))
    assert {(r.crawl_id, r.local_path): r.source_url for r in kept.collect()} == {("c", "p"): "u2", ("c", "q"): "u3", ("d", "p"): "u1"}


# --- paths ----------------------------------------------------------------------------------------------------------------

_segment = st.sampled_from(["a", "b", "c", "index.html", "ü n", "x.y"])
_file = st.builds(lambda d, f: "/".join([*d, f]), st.lists(_segment, max_size=5), st.sampled_from(["f.html", "g.png"]))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(_file, _file), min_size=150, max_size=150))
def test_relative_paths_are_those_of_posixpath(spark, cases):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, own string, target string")
    for r in df.withColumn("x", U.relative_path(F.col("own"), F.col("target"))).collect():
        assert r.x == posixpath.relpath("/" + r.target, posixpath.dirname("/" + r.own))


def test_external_and_typed_paths(spark):
    refs = spark.createDataFrame([("c", u, t, 1) for u, t in [
        ("http://own.com/logo", None), ("http://own.com/a.png", None), ("http://cdn.net:8080/x/y", None), ("http://CDN.net/s", "text/css"),
        ("http://own.com/odd.v2", None), ("http://e.org/../../etc/passwd", None)]], "crawl_id string, url string, content_type string, seq int")
    answers = spark.createDataFrame([("http://own.com/logo", "image/png"), ("http://own.com/a.png", "text/html"),
                                     ("http://cdn.net:8080/x/y", "image/jpeg; q=1"), ("http://own.com/odd.v2", "image/gif")], "url string, content_type string")
    named = lambda *a: {r.url: r.local_path for r in path_map(refs, *a).collect()}
    assert named() == {"http://CDN.net/s": "s.css"}
    assert named(answers) == {"http://CDN.net/s": "s.css", "http://own.com/logo": "logo.png", "http://cdn.net:8080/x/y": "x/y.jpg",
                              "http://own.com/odd.v2": "odd.v2"}
    homes = spark.createDataFrame([("c", "own.com")], "crawl_id string, seed_netloc string")
    away = named(answers, homes)
    assert away["http://cdn.net:8080/x/y"] == "_external/cdn.net_8080/x/y.jpg" and away["http://CDN.net/s"] == "_external/cdn.net/s.css"
    assert away["http://own.com/logo"] == "logo.png" and "http://own.com/a.png" not in away
    assert away["http://e.org/../../etc/passwd"].startswith("_external/e.org/") and ".." not in away["http://e.org/../../etc/passwd"]


def test_stylesheets_in_two_encodings(spark):
    df = spark.createDataFrame([(bytearray("a{content:'é'}".encode()),), (bytearray("a{content:'é'}".encode("latin-1")),), (bytearray(b""),), (None,)], "b binary")
    assert [r.t for r in df.select(C.decode_css(F.col("b")).alias("t")).collect()] == ["a{content:'é'}", "a{content:'é'}", "", None]


# --- stylesheets and their budget -----------------------------------------------------------------------------------------

def test_sheets_that_import_each_other_end(spark):
    css = {"http://s/a.css": '@import "b.css"; @import "a.css"; i{background:url(p.png)}', "http://s/b.css": '@import "c.css"; @import "gone.css";',
           "http://s/c.css": '@import "a.css"; @import "d.css";', "http://s/d.css": ""}
    edges = sheet_edges(spark.createDataFrame(list(css.items()), "url string, css string"))
    roots = spark.createDataFrame([("1", "http://s/a.css", 0), ("1", "http://s/a.css", 5), ("1", "http://s/d.css", 1), ("2", "http://s/c.css", 0)],
                                  "crawl_id string, url string, seq int")
    read = lambda depth: {(r.crawl_id, r.url[9:-4], r.level, r.root[9:-4]) for r in sheet_closure(roots, edges, depth).collect()}
    assert read(1) == {("1", "a", 0, "a"), ("1", "d", 0, "d"), ("2", "c", 0, "c")}
    assert read(2) == read(1) | {("1", "b", 1, "a"), ("2", "a", 1, "c"), ("2", "d", 1, "c")}
    assert read(None) == read(2) | {("1", "c", 2, "a"), ("1", "gone", 2, "a"), ("2", "b", 2, "c"), ("2", "gone", 3, "c")}
    assert sheet_closure(roots.limit(0), edges).count() == 0


def _brute(rows, total, largest):
    got = set()
    for key in {r[0] for r in rows}:
        left, have = total, set()
        for _, _, item, parent, size in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if item not in have and (parent is None or parent in have) and size is not None and size <= min(left, largest):
                have.add(item)
                left -= size
                got.add((key, item))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_files_follow_the_admission_of_their_sheet(spark, seed):
    rng = random.Random(seed)
    rows, sizes = [], {}
    for key in ("a", "b", None):
        o = 0
        for sheet in range(60):
            s = f"s{sheet}"
            rows.append((key, o := o + 1, s, None, sizes.setdefault((key, s), rng.choice([0.0, 1.0, 3.0, 20.0, 90.0, None]))))
            for _ in range(rng.randint(0, 6)):  # some are met below several sheets, some also on a page
                f = f"f{rng.randint(0, 60)}"
                rows.append((key, o := o + 1, f, s if rng.random() < 0.9 else None, sizes.setdefault((key, f), rng.choice([0.0, 1.0, 2.0, 7.0, 40.0]))))
    df = spark.createDataFrame(rows, "k string, o int, item string, parent string, size double")
    for total, largest in ((150.0, 1000.0), (37.0, 30.0), (0.0, 5.0)):
        got = offered_budget(df, "k", "item", ["o"], "parent", "size", largest, total)
        assert {(r.k, r.item) for r in got.collect()} == _brute(rows, total, largest)


def test_offers_deal_out_few_rows_of_used_up_keys(spark, monkeypatch):
    """Keys longer than both heads; budgets that end in the first, in the second and behind it."""
    from mirrorframe.session import Scratch
    rng = random.Random(5)
    rows, sizes = [], {}
    for key in ("a", None):
        o = 0
        for sheet in range(400):
            s = f"s{sheet}"
            rows.append((key, o := o + 1, s, None, sizes.setdefault((key, s), rng.choice([1.0, 3.0, 20.0, 90.0]))))
            for _ in range(rng.randint(2, 6)):
                f = f"f{rng.randint(0, 900)}"
                rows.append((key, o := o + 1, f, s if rng.random() < 0.9 else None, sizes.setdefault((key, f), rng.choice([1.0, 2.0, 7.0, 40.0]))))
    df = spark.createDataFrame(rows, "k string, o int, item string, parent string, size double")
    written, table, keep = [], Scratch.table, Scratch.keep

    def counted(write):
        def run(self, rows):
            out = write(self, rows)
            written.append(out.count())
            return out
        return run

    monkeypatch.setattr(Scratch, "table", counted(table))
    monkeypatch.setattr(Scratch, "keep", counted(keep))
    for total in (100.0, 3000.0, 12_000.0):
        written.clear()
        got = offered_budget(df, "k", "item", ["o"], "parent", "size", 50.0, total)
        assert {(r.k, r.item) for r in got.collect()} == _brute(rows, total, 50.0)
        if total == 100.0:
            assert sum(written) < 2 * len(rows)  # a table of all rows, and little more


def test_two_hundred_sheets_turned_away_take_no_more_rounds(spark, monkeypatch):
    from mirrorframe.session import Scratch
    rows = []
    for sheet in range(220):
        rows.append(("a", 10 * sheet, f"s{sheet}", None, 70.0 if sheet else 60.0))
        rows += [("a", 10 * sheet + i, f"f{sheet}-{i}", f"s{sheet}", 1.0) for i in (1, 2)]
    written = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df: written.append(1) or table(self, df))
    df = spark.createDataFrame(rows, "k string, o int, item string, parent string, size double")
    got = offered_budget(df, "k", "item", ["o"], "parent", "size", 100.0, 100.0)
    assert {r.item for r in got.collect()} == {"s0", "f0-1", "f0-2"}
    assert len(written) < 2 + 4 * 9  # phases follow the digits of the budget
    plain = df.where("parent IS NULL")
    assert {r.item for r in byte_budget(plain, "k", ["o"], "size", 100.0, 100.0).where("admitted").collect()} == {"s0"}


# --- clone ----------------------------------------------------------------------------------------------------------------

E = "http://example.com"
SITE = {E + "/": '<a href="/docs/guide">g</a><img src="/logo"><link rel="stylesheet" href="/css/a.css">',
        E + "/docs/guide": '<a href="/">home</a><img src="/logo" srcset="http://cdn.net/big 2x"><style>i{background:url(/bg)}</style>'}
BODIES = {E + "/logo": ("image/png", b"P"), "http://cdn.net/big": ("image/png", b"B"), E + "/bg": ("image/gif", b"G"),
          E + "/css/a.css": ("text/css", b'@import "deep/b.css"; a{background:url(/bg)}'),
          E + "/css/deep/b.css": ("text/css", b'@import "../a.css"; b{background:url(/leaf)}'), E + "/leaf": ("image/png", b"L")}


def _run(spark, bodies, snapshot=None, statuses=None, **cfg):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(SITE.items())], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("c", E + "/")], "crawl_id string, url string")
    rows = [(u, (statuses or {}).get(u, 200), t, bytearray(b), len(b), "e" + b.decode()[:1]) for u, (t, b) in bodies.items()]
    resp = spark.createDataFrame(rows, "url string, status int, content_type string, body binary, size long, etag string")
    return clone_run(pages, seeds, CrawlConfig(**cfg), responses=resp, snapshot=snapshot)


def test_clone_with_all_path_options(spark):
    files = {r.local_path: bytes(r.content).decode() for r in _run(
        spark, BODIES, relative=True, use_response_type=True, external_prefix=True, css_depth=2).files.collect()}
    assert files == {
        "index.html": '<a href="docs/guide.html">g</a><img src="logo.png"><link rel="stylesheet" href="css/a.css">',
        "docs/guide.html": '<a href="../index.html">home</a><img src="../logo.png" srcset="../_external/cdn.net/big.png 2x">'
                           '<style>i{background:url("../bg.gif")}</style>',
        "css/a.css": '@import "deep/b.css"; a{background:url("../bg.gif")}',
        "css/deep/b.css": '@import "../a.css"; b{background:url("../../leaf.png")}',
        "logo.png": "P", "_external/cdn.net/big.png": "B", "bg.gif": "G", "leaf.png": "L"}


def test_clone_starts_from_the_last_snapshot(spark):
    first = _run(spark, BODIES).snapshot
    assert {r.url for r in first.collect()} == set(BODIES) - {E + "/leaf"}  # sheets of sheets are not read at depth 1
    bodies = {**BODIES, E + "/bg": ("image/gif", b"NEW"), E + "/logo": ("image/png", b"")}
    again = _run(spark, bodies, first, {E + "/logo": 304, "http://cdn.net/big": 404, E + "/css/a.css": 304})
    files = {r.local_path: bytes(r.content).decode() for r in again.files.collect()}
    assert set(files) == {"index.html", "docs/guide.html", "bg.html"} and files["bg.html"] == "NEW"
    assert 'src="logo.html"' in files["index.html"] and 'href="css/a.css"' in files["index.html"]  # referred to, not stored again
    assert {r.url: (r.change, r.etag) for r in again.snapshot.collect()} == {
        E + "/logo": ("unchanged", "e"), E + "/bg": ("changed", "eN"), "http://cdn.net/big": ("gone", "eB"),
        E + "/css/a.css": ("unchanged", "e@"), E + "/css/deep/b.css": ("gone", "e@")}


# --- streams --------------------------------------------------------------------------------------------------------------

def _append(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_jobs_end_by_their_timer(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    t = lambda minutes: T1 + dt.timedelta(minutes=minutes)
    schema = "job_id string, ts timestamp, seq long, kind string, status string, pages_cloned int, created_at timestamp"
    batches = [
        [("a", t(0), -1, "create", "running", 0, t(0)), ("b", t(1), -1, "create", "running", 0, t(1)), ("ghost", t(2), 1, "update", "done", 9, None)],
        [("a", t(31), 2, "update", None, 5, None), ("a", t(30), 1, "update", "late one", 3, None), ("c", t(40), -1, "create", "running", 0, t(40))],
        [("b", t(70), 3, "update", "done", None, None), ("d", t(75), -1, "create", "running", 0, t(75))],
        [("a", t(76), 4, "update", "revived", 7, None)]]
    stream = lambda: expiring_jobs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "5 minutes", 3600)
    seen = []
    for rows in batches:  # the stream is stopped and started again after each
        _append(spark.createDataFrame(rows, schema), path)
        seen.append({r.job_id: (r.status, r.pages_cloned) for r in live_job_table(stream(), "jobs", out).collect()})
    assert seen[0] == {"a": ("running", 0), "b": ("running", 0)}
    assert seen[1] == {"a": ("late one", 5), "b": ("running", 0), "c": ("running", 0)}
    assert set(seen[2]) == {"c", "d"}   # 75 - 5 minutes are over a's and b's hour
    assert set(seen[3]) == {"c", "d"}   # a patch does not bring a job back


def test_many_jobs_end_without_a_call_for_each(spark, tmp_path, monkeypatch):
    from pyspark.sql.group import GroupedData

    def refuse(*args, **kwargs):
        raise AssertionError("state is called job by job")

    for way in ("transformWithState", "transformWithStateInPandas", "applyInPandasWithState"):
        monkeypatch.setattr(GroupedData, way, refuse)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda minutes: T1 + dt.timedelta(minutes=minutes)
    schema = "job_id string, ts timestamp, seq long, kind string, status string, pages_cloned int, created_at timestamp"
    for k in range(3):  # a thousand jobs every forty minutes; each batch patches the ones of the batch before, too
        rows = [(f"{k}-{i}", at(40 * k), -1, "create", "running", 0, at(40 * k)) for i in range(1000)]
        rows += [(f"{k - 1}-{i}", at(40 * k), i, "update", None, i, None) for i in range(1000) if k]
        _append(spark.createDataFrame(rows, schema), path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.job_id: (r.status, r.pages_cloned) for r in live_job_table(expiring_jobs(stream, "5 minutes", 3600), "jobs", out).collect()}
    # 80 - 5 minutes are over the hour of the first thousand
    assert got == {f"1-{i}": ("running", i) for i in range(1000)} | {f"2-{i}": ("running", 0) for i in range(1000)}
    ended = [r.job_id for r in spark.read.parquet(f"{out}/table").where("expired").collect()]
    assert sorted(ended) == sorted(f"0-{i}" for i in range(1000))


def test_arrivals_out_of_order_give_the_batch_schedule(spark, tmp_path):
    from mirrorframe.operators.policy import token_bucket
    rng = random.Random(6)
    requests = [(i, rng.choice(["h1", "h1", "h2", None]), round(rng.random() * 60, 3)) for i in range(400)]
    schema = "event_id long, host string, arrival double"
    whole, _ = token_bucket(spark.createDataFrame(requests, schema), None, 1.0, 5)
    want = {r.event_id: r.start_at for r in whole.collect()}
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    order = sorted(requests, key=lambda r: r[2] + rng.random() * 15)  # up to 15 seconds out of order
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    for i in range(0, 400, 100):
        rows = order[i:i + 100]
        rng.shuffle(rows)
        _append(spark.createDataFrame(rows, schema), path)
        table = token_bucket_reordered(stream(), "r", 15.0, 1.0, 5, out)
        assert table.count() == i + 100  # what waits is listed as it would be scheduled now
    got = {r.event_id: (r.start_at, r.late) for r in table.collect()}
    assert {i: late for i, (_, late) in got.items()} == dict.fromkeys(want, False)
    assert all(abs(got[i][0] - want[i]) < 1e-6 for i in want)
    _append(spark.createDataFrame([(900, "h1", 1.0), (901, "h1", 80.0)], schema), path)
    more = {r.event_id: r for r in token_bucket_reordered(stream(), "r", 15.0, 1.0, 5, out).collect()}
    assert more[900].late and more[900].start_at is None and not more[901].late and len(more) == 402


def test_frontier_forgets_behind_the_watermark(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "page_id long, url string, html string, ts timestamp"
    page = lambda i, minute, *links: (i, f"http://s.com/p{i}", "".join(f'<a href="/{x}">x</a>' for x in links),
                                      T1 + dt.timedelta(minutes=minute))
    emitted = []
    for rows in ([page(1, 0, "a", "b", "a")], [page(2, 5, "a", "c")], [page(3, 60, "d")], [page(4, 61, "a"), page(5, 2, "late")]):
        _append(spark.createDataFrame(rows, schema), path)
        stream = spark.readStream.schema(schema).parquet(path)
        table = run_available(streaming_frontier(stream, "10 minutes"), "f", path=out)
        emitted.append(sorted(r.norm_url[13:] for r in table.collect()))
    assert emitted == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"], ["a", "a", "b", "c", "d"]]
