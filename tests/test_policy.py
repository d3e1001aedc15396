"""Byte budget, host schedule, private addresses, robots parsing against
plain-Python statements of the semantics."""
import ipaddress
import random
import urllib.robotparser

from pyspark.sql import functions as F

from mirrorframe.operators.policy import byte_budget, host_schedule, is_private_ip, prefix_sum
from mirrorframe.operators.robots import parse_robots, robots_filter
from mirrorframe.functions import urls as U


def greedy(sizes, max_asset, max_total):
    rem, out = max_total, []
    for s in sizes:
        ok = s <= max_asset and s <= rem
        if ok:
            rem -= s
        out.append(ok)
    return out


def test_byte_budget_matches_greedy(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for key in range(6):
        sizes = [float(rnd.randint(1, 60)) for _ in range(rnd.randint(1, 40))]
        total = 10_000.0 if key == 0 else float(rnd.randint(20, 400))  # key 0 never overflows
        for i, s in enumerate(sizes):
            rows.append((key, i, s, total))
        for i, ok in enumerate(greedy(sizes, 50.0, total)):
            want[(key, i)] = ok
    # one shared total per call: run per distinct total
    got = {}
    df = spark.createDataFrame(rows, "k long, i long, size double, total double")
    for total in sorted({r[3] for r in rows}):
        part = df.where(F.col("total") == total).drop("total")
        for r in byte_budget(part, "k", ["i"], "size", max_asset=50.0, max_total=total).collect():
            got[(r.k, r.i)] = r.admitted
    assert got == want


def test_byte_budget_deals_out_few_rows_of_used_up_keys(spark, monkeypatch):
    """Keys longer than both heads; budgets that end in the first, in the second and behind it."""
    from mirrorframe.session import Scratch
    rnd = random.Random(9)
    size = {key: [float(rnd.choice([0, 1, 2, 3, 20, 55]) if key is None else rnd.randint(1, 50)) for _ in range(1500)] for key in (1, 2, None)}
    rows = [(key, i, s) for key, sizes in size.items() for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k long, i long, size double")
    written, table, keep = [], Scratch.table, Scratch.keep

    def counted(write):
        def run(self, rows):
            out = write(self, rows)
            written.append(out.count())
            return out
        return run

    monkeypatch.setattr(Scratch, "table", counted(table))
    monkeypatch.setattr(Scratch, "keep", counted(keep))
    for total in (300.0, 7000.0, 24_000.0):
        written.clear()
        got = {(r.k, r.i): r.admitted for r in byte_budget(df, "k", ["i"], "size", max_asset=50.0, max_total=total).collect()}
        assert got == {(key, i): ok for key, sizes in size.items() for i, ok in enumerate(greedy(sizes, 50.0, total))}
        if total == 300.0:
            assert sum(written) < 2 * len(rows)  # a table of all rows, and little more


def test_byte_budget_keeps_unknown_sizes_and_keys(spark):
    """A list that lets one item in at a time, NULL sizes and a NULL key; rows out = rows in."""
    rows = [(None, i, s) for i, s in enumerate([5, None, 300, 4])]
    rows += [(1, i, s) for i, s in enumerate(x for k in range(40) for x in (1, 40 - k))]
    df = spark.createDataFrame(rows, "k long, i long, size long")
    got = {(r.k, r.i): r.admitted for r in byte_budget(df, "k", ["i"], "size", max_asset=250, max_total=100).collect()}
    want = {}
    for key in (None, 1):
        mine = [(i, s) for k, i, s in rows if k == key]
        for (i, _), ok in zip(mine, greedy([1e9 if s is None else s for _, s in mine], 250, 100)):
            want[key, i] = ok
    assert got == want


def test_prefix_sum_hot_key(spark):
    rows = [(0 if i % 3 else i % 7, i, float(i % 5)) for i in range(3000)]  # key 0 holds 2/3
    df = spark.createDataFrame(rows, "k long, o long, v double")
    got = {(r.k, r.o): r.cum for r in prefix_sum(df, ["k"], ["o"], F.col("v"), partitions=16).collect()}
    run = {}
    for k, o, v in sorted(rows, key=lambda x: (x[0], x[1])):
        run[k] = run.get(k, 0.0) + v
        assert got[(k, o)] == run[k]


def test_host_schedule_is_token_bucket(spark):
    reqs = [("a.com", i) for i in range(45)] + [("b.com", i) for i in range(3)]
    df = spark.createDataFrame(reqs, "host string, i long")
    got = {(r.host, r.i): r.start_at for r in host_schedule(df, ["i"]).collect()}
    # simulate a bucket that starts full (20 tokens, 10/s), all queued at t=0
    for host in ("a.com", "b.com"):
        tokens, t = 20.0, 0.0
        for i in range(45 if host == "a.com" else 3):
            if tokens < 1:
                t += (1 - tokens) / 10.0
                tokens = 1.0
            tokens -= 1
            assert abs(got[(host, i)] - t) < 1e-9


def test_private_ranges(spark):
    ips = ["127.0.0.1", "10.0.0.1", "192.168.1.1", "169.254.1.1", "93.184.216.34", "172.16.0.1",
           "172.32.0.1", "100.64.0.1", "224.0.0.1", "192.0.0.9", "192.0.0.10", "192.0.0.8", "0.1.2.3",
           "240.0.0.1", "255.255.255.255", "198.18.0.1", "8.8.8.8", "not-an-ip", "256.1.1.1"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in ips], "ip string")
           .select(is_private_ip("ip")).collect()]
    for ip, g in zip(ips, got):
        try:
            a = ipaddress.ip_address(ip)
            want = a.is_private or a.is_loopback or a.is_link_local
        except ValueError:
            want = False
        assert g == want, ip


def test_robots_against_stdlib(spark):
    body = ("# c\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /a/b\nDisallow: /a\n"
            "Disallow: /p%20q\nDisallow:\n\nUser-agent: *\nDisallow: /z\n")
    urls = ["/", "/a", "/a/b/c", "/a/c", "/z", "/p q", "/p%20q/x", "/x?a=1", "/a;p"]
    rp = urllib.robotparser.RobotFileParser()
    rp.parse(body.splitlines())
    want = [rp.can_fetch("*", "http://h.com" + u) for u in urls]
    rules = parse_robots(spark.createDataFrame([("h.com", 200, body)], "host string, status int, body string"))
    df = spark.createDataFrame([(i, "http://h.com" + u) for i, u in enumerate(urls)], "i long, norm_url string")
    got = {r.i: r.robots_allowed for r in robots_filter(df, rules).collect()}
    assert [got[i] for i in range(len(urls))] == want


def test_robots_groups_against_stdlib(spark):
    """Files of random agent, rule, blank and other lines; a file of very many rules."""
    rnd = random.Random(3)
    some = ["User-agent: *", "User-agent: x", "user-AGENT : * # c", "Disallow: /a", "Allow: /a/b", "Disallow: /", "Disallow:", "",
            "  ", "# note", "Sitemap: http://h.com/s.xml", "nonsense", "Disallow: /%61b"]
    files = ["\n".join(rnd.choice(some) for _ in range(rnd.randrange(14))) for _ in range(300)]
    paths = ["/", "/a", "/a/b/c", "/ab", "/z"]
    rows = [(f"h{i}.com", 200, f) for i, f in enumerate(files)]
    rules = parse_robots(spark.createDataFrame(rows, "host string, status int, body string"))
    urls = [(f"http://h{i}.com{p}",) for i in range(len(files)) for p in paths]
    got = {r.norm_url: r.robots_allowed for r in robots_filter(spark.createDataFrame(urls, "norm_url string"), rules).collect()}
    for i, f in enumerate(files):
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(f.splitlines())
        for p in paths:
            assert got[f"http://h{i}.com{p}"] == rp.can_fetch("*", f"http://h{i}.com{p}"), (f, p)
    n = 200_000
    body = "User-agent: *\n" * 1000 + "\n" + "User-agent: *\n" + "".join(f"Disallow: /{i}\n" for i in range(n))
    many = parse_robots(spark.createDataFrame([("h.com", 200, body)], "host string, status int, body string"))
    last = many.orderBy(F.desc("line_no")).first()
    assert many.count() == n and (last.line_no, last.prefix) == (n + 1001, f"/{n - 1}")
