"""Fetch policies as DataFrame operators: response classification (S2, S3),
retry plan (W6), per-host politeness schedule (W3), byte budget (W2, P6) and
private-address blocking (U9, J4, P4).

Per-key running sums and maxima use ``prefix``: the rows are range partitioned
on (key, order), so one hot key (a host or crawl holding a third of all rows)
is split across many tasks; each task works locally and adds the totals of the
earlier ranges of the same key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BURST, MAX_ASSET_SIZE, MAX_RETRIES, MAX_TOTAL_BYTES, RATE_PER_SEC
from ..functions import urls as U
from ..session import Scratch


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys are equal; the key columns of the left."""
    r = right.select(*[F.col(k).alias("_n_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_n_" + k)) for k in keys])
    return left.join(r, cond, how).drop(*["_n_" + k for k in keys])


def ranged(df: DataFrame, keys: list[str], order: list[str], scratch: Scratch,
           partitions: int | None = None) -> DataFrame:
    """The rows in ranges of (key, order), each with its range number ``_pid``.
    The input is written before it is sampled and once more in its ranges, so
    that it is computed once and the numbers never change."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.keep(scratch.table(df).repartitionByRange(n, *keys, *order)
                        .withColumn("_pid", F.spark_partition_id()))


def prefix_over(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str = "cum",
                how: str = "sum", before: str | None = None) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` over ``ranged`` rows, inclusive
    as ``out`` and, if asked for, exclusive as ``before`` (NULL at a key's first
    row for a maximum)."""
    agg = {"sum": F.sum, "max": F.max}[how]
    both = (lambda a, b: a + b) if how == "sum" else F.greatest
    rows = rows.withColumn("_v", value)
    w = Window.partitionBy(*keys, "_pid").orderBy(*order)
    here = rows.withColumn("_in", agg("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if before:
        here = here.withColumn("_ex", agg("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    total = rows.groupBy(*keys, "_pid").agg(agg("_v").alias("_t"))
    w2 = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = total.select(*keys, "_pid", agg("_t").over(w2).alias("_off"))
    j = null_safe(here, off, [*keys, "_pid"])
    if how == "sum":
        j = j.withColumn("_off", F.coalesce("_off", F.lit(0)))
    j = j.withColumn(out, both(F.col("_in"), F.col("_off")))
    if before:
        ex = F.coalesce("_ex", F.lit(0)) if how == "sum" else F.col("_ex")
        j = j.withColumn(before, both(ex, F.col("_off")))
    return j.drop("_v", "_in", "_ex", "_off")


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column | None = None,
               out: str = "cum", partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` (default 1 = running count) per
    ``keys`` in ``order``, which is unique within a key.  NULL keys are a key."""
    with Scratch(df.sparkSession, "prefix") as scratch:
        rows = ranged(df, keys, order, scratch, partitions)
    return prefix_over(rows, keys, order, value if value is not None else F.lit(1), out).drop("_pid")


# ---------------------------------------------------------------------------
# W3 politeness schedule (token bucket, all requests queued at t=0), T4 with
# arrivals
# ---------------------------------------------------------------------------

def host_schedule(requests: DataFrame, order: list[str], host_col: str = "host",
                  rate: float = RATE_PER_SEC, burst: int = BURST) -> DataFrame:
    """Earliest start (seconds) of each queued request of a host under a token
    bucket that starts full: request n (0-based) waits ``max(0, (n+1-burst)/rate)``.
    Adds ``n`` and ``start_at``."""
    ranked = prefix_sum(requests, [host_col], order, out="_cnt")
    n = F.col("_cnt") - 1
    return (ranked.withColumn("n", n.cast("long"))
            .withColumn("start_at", F.greatest(F.lit(0.0), (n + 1 - burst) / F.lit(float(rate))))
            .drop("_cnt"))


def token_bucket(requests: DataFrame, state: DataFrame | None = None, rate: float = RATE_PER_SEC, burst: int = BURST,
                 id_col: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """T4: ``requests(event_id, host, arrival)`` -> (starts, state).

    A request starts when it has arrived, its host's previous request has
    started and the bucket (full at first) holds a token.  In (arrival, id)
    order the n-th request (0-based) of a host starts at
    ``max(a_n, (n - burst + 1) / rate + max over earlier k of (a_k - k / rate))``,
    so a running maximum is all that is needed, and ``state(host, seen, peak)``
    (requests so far, that maximum) carries it over to later requests.
    ``starts`` adds ``start_at`` and ``wait_s`` to the requests."""
    spark = requests.sparkSession
    with Scratch(spark, "bucket") as scratch:
        rows = requests.select(id_col, "host", F.col("arrival").cast("double").alias("arrival"))
        order = ["arrival", id_col]
        base = ranged(rows, ["host"], order, scratch)
        if state is not None:
            base = null_safe(base, state.select("host", "seen", "peak"), ["host"], "left")
        else:
            base = base.withColumn("seen", F.lit(None).cast("long")).withColumn("peak", F.lit(None).cast("double"))
        numbered = prefix_over(base, ["host"], order, F.lit(1), "_n").withColumn(
            "_n", F.col("_n") - 1 + F.coalesce("seen", F.lit(0)))
        done = scratch.keep(prefix_over(numbered, ["host"], order, F.col("arrival") - F.col("_n") / float(rate),
                                        "_top", "max", "_earlier"))
    earliest = F.greatest("_earlier", "peak") + (F.col("_n") - burst + 1) / float(rate)
    start = F.greatest("arrival", earliest)  # greatest() passes over NULLs
    starts = done.select(id_col, "host", "arrival", start.alias("start_at"), (start - F.col("arrival")).alias("wait_s"))
    new = done.groupBy("host").agg((F.max("_n") + 1).alias("seen"),
                                   F.greatest(F.max("_top"), F.max("peak")).alias("peak"))
    if state is not None:
        old = state.select("host", "seen", "peak")
        new = new.unionByName(null_safe(old, new.select("host"), ["host"], "left_anti"))
    return starts, new


# ---------------------------------------------------------------------------
# S2 / S3 response classification, U12 Retry-After, W6 retry plan
# ---------------------------------------------------------------------------

def classify_page(status, content_type) -> Column:
    """Outcome of a page fetch attempt: 'retry_429', 'error' (other 4xx/5xx,
    retried), 'page' (content type contains text/html or text/plain) or
    'not_page' (kept as no page, not retried)."""
    s, ct = U._c(status), F.coalesce(U._c(content_type), F.lit(""))
    return (F.when(s == 429, F.lit("retry_429"))
            .when(s >= 400, F.lit("error"))
            .when(ct.contains("text/html") | ct.contains("text/plain"), F.lit("page"))
            .otherwise(F.lit("not_page")))


def classify_asset(status, size, url=None, already=None, max_asset_size: int = MAX_ASSET_SIZE) -> Column:
    """Outcome of an asset download attempt: 'skip' (already downloaded or a
    ``data:`` URL), 'retry_429', 'unchanged' (304), 'error' (retried),
    'too_large' (> max_asset_size), 'empty' (no body) or 'accept'."""
    s, sz = U._c(status), U._c(size)
    skip = F.lit(False)
    if already is not None:
        skip = skip | F.coalesce(U._c(already), F.lit(False))
    if url is not None:
        skip = skip | U._c(url).startswith("data:")
    return (F.when(skip, F.lit("skip"))
            .when(s == 429, F.lit("retry_429"))
            .when(s == 304, F.lit("unchanged"))
            .when(s >= 400, F.lit("error"))
            .when(sz > max_asset_size, F.lit("too_large"))
            .when(F.coalesce(sz, F.lit(0)) <= 0, F.lit("empty"))
            .otherwise(F.lit("accept")))


def retry_wait(status, retry_after, attempt, now) -> Column:
    """Seconds to wait after a failed attempt (1-based ``attempt``): the
    Retry-After value for a 429 when it parses, else ``2**(attempt-1)``."""
    backoff = F.pow(F.lit(2.0), U._c(attempt) - 1)
    ra = U.retry_after_seconds(retry_after, now)
    return F.when(U._c(status) == 429, F.coalesce(ra, backoff)).otherwise(backoff)


def number_attempts(responses: DataFrame, url_col: str = "url", order: list[str] | None = None) -> DataFrame:
    """Attempt number (1-based) per URL in time order (skew-safe)."""
    order = order or ["ts", "event_id"]
    return prefix_sum(responses, [url_col], order, out="attempt").withColumn("attempt", F.col("attempt").cast("int"))


def retry_plan(responses: DataFrame, kind: str = "page", max_retries: int = MAX_RETRIES,
               url_col: str = "url") -> DataFrame:
    """Per URL, from its latest attempt: 'done' (page/asset obtained or a
    final non-retryable answer), 'retry' at ``next_at`` or 'fail' once
    ``max_retries`` attempts were used.  Latest attempt by ``max_by`` (a
    partial aggregate, no per-URL sort)."""
    latest = (responses.groupBy(url_col)
              .agg(F.max_by(F.struct("status", "content_type", "retry_after", "size", "ts", "attempt"),
                            F.struct("attempt", "ts")).alias("l"), F.count(F.lit(1)).alias("attempts"))
              .select(url_col, "attempts", "l.*"))
    outcome = (classify_page("status", "content_type") if kind == "page"
               else classify_asset("status", "size"))
    retryable = outcome.isin("retry_429", "error")
    wait = retry_wait("status", "retry_after", "attempt", "ts")
    action = (F.when(~retryable, F.lit("done"))
              .when(F.col("attempt") >= max_retries, F.lit("fail"))
              .otherwise(F.lit("retry")))
    return latest.select(
        url_col, "attempt", "status", outcome.alias("outcome"), action.alias("action"),
        F.when(action == "retry", F.col("ts") + F.make_interval(secs=wait)).alias("next_at"))


# ---------------------------------------------------------------------------
# W2 + P6 byte budget
# ---------------------------------------------------------------------------

#: Rows of a key that are judged first; the engine cuts groups before the shuffle up to 1,000 rows of each.
HEADS = (60, 960)


def _head(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows of each key (all, if None), with those that share the place of the last one."""
    if n is None:
        return rows
    at = F.rank().over(Window.partitionBy("_k").orderBy("_o"))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def _after(rows: DataFrame, head: DataFrame, left: DataFrame) -> DataFrame:
    """The rows behind each key's ``head`` that the rest of its budget,
    ``left(_k, _end)``, can hold, with that rest: what is larger than it never
    fits."""
    cut = head.groupBy("_k").agg(F.max("_o").alias("_cut"), F.max("_r").alias("_r"))
    rest = null_safe(cut, left, ["_k"], "left").select("_k", "_cut", F.coalesce("_end", "_r").alias("_r"))
    return null_safe(rows.drop("_r"), rest, ["_k"]).where((F.col("_o") > F.col("_cut")) & (F.col("_s") <= F.col("_r"))).drop("_cut")


def _left(phase: DataFrame) -> DataFrame:
    """What a phase leaves of each key's budget: what its event left, or all but its items."""
    return phase.groupBy("_k").agg(F.coalesce(F.max("_r"), F.max("_was") - F.sum(F.when(F.col("_in"), F.col("_s")).otherwise(0.0))).alias("_end"))


def _least(left: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, left).groupBy("_k").agg(F.min("_end").alias("_end"))


def _power(r: Column) -> Column:
    """The largest power of two up to ``r`` (0 for none)."""
    power = F.pow(F.lit(2.0), F.floor(F.log2(r)))
    return F.when(r > 0, F.when(power > r, power / 2).otherwise(power)).otherwise(F.lit(0.0))


def byte_budget(items: DataFrame, key: str, order: list[str], size_col: str = "size",
                max_asset: float = MAX_ASSET_SIZE, max_total: float = MAX_TOTAL_BYTES) -> DataFrame:
    """Greedy admission in ``order`` (unique within a key) per ``key``: an item
    is admitted when it is at most ``max_asset`` and fits in what is left of
    ``max_total``; one that does not fit is skipped and later smaller ones may
    still fit.  Adds ``admitted``; an item of unknown size is not admitted, a
    NULL key is a key of its own.

    Exact, in phases.  With r left and T the largest power of two up to r,
    items up to T fit until their running sum brings r below T, and a larger
    item fits only if it is at most r minus the sum before it.  The first such
    event of a key ends its phase: all before it is decided, and less than T
    is left.  So the phases follow the number of binary digits of
    ``max_total`` over the smallest size, never the number of items.  Only
    (key, order, size) rows take part, in ranges that are dealt out once.

    Phases run over the first rows of each key (``HEADS``), then over what the
    rest of the budget can hold of the next ones, then over all such rows: a
    key whose budget is soon used up has few left to deal out."""
    with Scratch(items.sparkSession, "budget") as scratch:
        size = F.col(size_col).cast("double")
        ok = size.isNotNull() & (size <= F.lit(float(max_asset))) & (size <= F.lit(float(max_total)))
        narrow = items.where(ok).select(F.col(key).alias("_k"), F.struct(*order).alias("_o"), size.alias("_s"))
        todo = scratch.table(narrow).withColumn("_r", F.lit(float(max_total)))
        admitted = []
        for n in (*HEADS, None):
            head = ranged(_head(todo, n), ["_k"], ["_o"], scratch)
            fits, left = _byte_phases(head, scratch)
            admitted += fits
            if n is None:
                break
            todo = scratch.table(_after(todo, head, left))
            if todo.isEmpty():
                break
        chosen = scratch.keep(reduce(DataFrame.unionByName, admitted).withColumn("admitted", F.lit(True)))
    j = items.join(chosen, F.col(key).eqNullSafe(F.col("_k")) & (F.struct(*order).eqNullSafe(F.col("_o"))), "left")
    return j.select(*[items[c] for c in items.columns], F.coalesce("admitted", F.lit(False)).alias("admitted"))


def _byte_phases(open_: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The admitted ``(_k, _o)`` of ``ranged`` rows with ``_r`` left, a table a phase, and what is left of each key's budget."""
    admitted, ends = [], []
    while True:
        small = F.col("_s") <= F.col("_t")
        c = prefix_over(open_.withColumn("_t", _power(F.col("_r"))), ["_k"], ["_o"], F.when(small, F.col("_s")).otherwise(0.0),
                        "_cum", before="_before")
        left = F.col("_r") - F.when(small, F.col("_cum")).otherwise(F.col("_before") + F.col("_s"))
        event = F.when(small, left < F.col("_t")).otherwise(left >= 0)
        c = c.select("_k", "_o", "_s", "_pid", F.col("_r").alias("_was"), small.alias("_small"), event.alias("_event"), left.alias("_left"))
        first = c.where("_event").groupBy("_k").agg(F.min(F.struct("_o", "_left")).alias("_e"))
        j = null_safe(c, first, ["_k"], "left")
        decided = F.col("_e").isNull() | (F.col("_o") <= F.col("_e._o"))
        j = scratch.table(j.select("_k", "_o", "_s", "_pid", "_was", decided.alias("_decided"),
                                   (decided & (F.col("_small") | (F.col("_o") == F.col("_e._o")))).alias("_in"),
                                   F.col("_e._left").alias("_r")))
        admitted.append(j.where("_in").select("_k", "_o"))
        ends.append(_left(j))
        # what is larger than the rest of the budget never fits
        open_ = j.where(~F.col("_decided") & (F.col("_s") <= F.col("_r"))).select("_k", "_o", "_s", "_pid", "_r")
        if open_.isEmpty():
            return admitted, _least(ends)


def offered_budget(meetings: DataFrame, key: str, item: str, order: list[str], parent: str, size_col: str = "size",
                   max_asset: float = MAX_ASSET_SIZE, max_total: float = MAX_TOTAL_BYTES) -> DataFrame:
    """Greedy admission, as ``byte_budget``, of items that are offered only
    where another item was admitted: a stylesheet's files follow it, and a
    stylesheet that is not stored refers to nothing.

    ``meetings(key, item, *order, parent, size)``: an item may be met several
    times; a meeting with a ``parent`` is one only if that item of the same
    key was admitted before it (parents have meetings without a parent, which
    come before those of their items).  An item is judged where it is first
    met; what did not fit once never fits later.  Returns ``(key, item,
    *order)`` of the admitted, at that meeting.

    One scan in the phases of ``byte_budget``: with r left and T the largest
    power of two up to r, every item up to T before the phase's end is
    admitted, and no larger one is; so it is known which meetings before the
    end take place, without judging the parents one by one.  Phases follow
    the binary digits of the budget, not the number of items or of parents
    that are turned away.  They run over the first meetings of each key, then
    over what the rest of the budget can hold, as there."""
    with Scratch(meetings.sparkSession, "offers") as scratch:
        size = F.col(size_col).cast("double")
        ok = size.isNotNull() & (size <= F.lit(float(max_asset))) & (size <= F.lit(float(max_total)))
        todo = scratch.table(meetings.where(ok).select(
            F.col(key).alias("_k"), F.col(item).alias("_i"), F.struct(*order).alias("_o"), size.alias("_s"),
            F.col(parent).alias("_p"))).withColumns({"_r": F.lit(float(max_total)), "_offered": F.col("_p").isNull()})
        admitted = []
        for n in (*HEADS, None):
            head = _head(todo, n) if n is None else scratch.table(_head(todo, n))
            waits = head.where("NOT _offered")
            sizes = todo if n is None else null_safe(
                todo, waits.select("_k", F.col("_p").alias("_i")).distinct(), ["_k", "_i"], "left_semi")
            sizes = sizes.groupBy("_k", "_i").agg(F.max("_s").alias("_ps")).withColumnRenamed("_i", "_p")
            rows = head.where("_offered").withColumn("_ps", F.lit(None).cast("double")).unionByName(
                null_safe(waits, sizes, ["_k", "_p"]))
            fits, left, closed = _offer_phases(ranged(rows, ["_k"], ["_o"], scratch), scratch)
            admitted += fits
            if n is None:
                break
            todo = scratch.table(_still_offered(_after(todo, head, left), closed))
            if todo.isEmpty():
                break
        chosen = scratch.keep(reduce(DataFrame.unionByName, admitted))
    return chosen.select(F.col("_k").alias(key), F.col("_i").alias(item), *[F.col(f"_o.{c}").alias(c) for c in order if c not in (key, item)])


def _still_offered(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """The meetings of items that are not ``closed(_k, _i, _in)``, without those whose parent was turned away."""
    rows = null_safe(rows, closed.select("_k", "_i"), ["_k", "_i"], "left_anti")
    rows = null_safe(rows, closed.withColumnRenamed("_i", "_p"), ["_k", "_p"], "left")
    return rows.where(F.coalesce("_in", F.lit(True))).withColumn(
        "_offered", F.col("_offered") | F.coalesce("_in", F.lit(False))).drop("_in")


def _offer_phases(open_: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The admitted ``(_k, _i, _o)`` of ``ranged`` meetings with ``_r`` left, a
    table a phase, what is left of each key's budget, and all items that were
    judged, ``(_k, _i, _in)``."""
    keep = ["_k", "_i", "_o", "_s", "_p", "_ps", "_pid", "_offered"]
    admitted, ends, judged = [], [], []
    while True:
        x = open_.withColumn("_t", _power(F.col("_r"))).withColumn("_live", F.col("_offered") | (F.col("_ps") <= F.col("_t")))
        firsts = x.where("_live").groupBy("_k", "_i").agg(F.min("_o").alias("_f"))
        x = null_safe(x, firsts, ["_k", "_i"], "left").withColumn(
            "_met", F.col("_live") & F.coalesce(F.col("_o") == F.col("_f"), F.lit(False)))
        x = scratch.table(x.drop("_f", "_live"))
        small = F.col("_s") <= F.col("_t")
        c = prefix_over(x, ["_k"], ["_o"], F.when(F.col("_met") & small, F.col("_s")).otherwise(0.0), "_cum", before="_before")
        left = F.col("_r") - F.when(small, F.col("_cum")).otherwise(F.col("_before") + F.col("_s"))
        event = F.col("_met") & F.when(small, left < F.col("_t")).otherwise(left >= 0)
        c = c.select(*keep, "_met", F.col("_r").alias("_was"), small.alias("_small"), event.alias("_event"), left.alias("_left"))
        first = c.where("_event").groupBy("_k").agg(F.min(F.struct("_o", "_left")).alias("_e"))
        j = null_safe(c, first, ["_k"], "left")
        decided = F.col("_met") & (F.col("_e").isNull() | (F.col("_o") <= F.col("_e._o")))
        j = scratch.table(j.select(*keep, "_was", decided.alias("_decided"), F.col("_e._left").alias("_r"), F.coalesce(
            decided & (F.col("_small") | (F.col("_o") == F.col("_e._o"))), F.lit(False)).alias("_in")))
        admitted.append(j.where("_in").select("_k", "_i", "_o"))
        ends.append(_left(j))
        # closed items: judged ones, and those that are larger than the rest of the budget
        rest = j.where(~F.col("_decided") & F.col("_r").isNotNull())
        closed = scratch.table(j.where("_decided").select("_k", "_i", "_in").unionByName(
            rest.where(F.col("_s") > F.col("_r")).select("_k", "_i", F.lit(False).alias("_in"))).groupBy("_k", "_i").agg(
            F.max("_in").alias("_in")))
        judged.append(closed)
        open_ = scratch.table(_still_offered(rest.drop("_in", "_decided", "_was"), closed))
        if open_.isEmpty():
            return admitted, _least(ends), reduce(DataFrame.unionByName, judged).groupBy("_k", "_i").agg(F.max("_in").alias("_in"))


# ---------------------------------------------------------------------------
# U9 / J4 / P4 private addresses
# ---------------------------------------------------------------------------

# Address blocks that count as private, loopback or link-local for IPv4
# (fixed values; first and last address of each block).
PRIVATE_V4 = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
]


def _v4_num(s: str) -> int:
    a, b, c, d = (int(x) for x in s.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def ipv4_to_long(ip) -> Column:
    """Dotted IPv4 -> number; NULL when not a valid dotted quad."""
    return U.let(U._c(ip), _ipv4_to_long)


def _ipv4_to_long(s: Column) -> Column:
    parts = F.split(s, r"\.")
    ok = s.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    num = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))
    return F.when(ok, num)


def is_private_ip(ip) -> Column:
    """Private, loopback or link-local IPv4 address (range test folded into
    one OR of BETWEENs; no join)."""
    def test(n):
        inside = reduce(lambda a, b: a | b, [n.between(_v4_num(lo), _v4_num(hi)) for lo, hi in PRIVATE_V4])
        return F.coalesce(inside, F.lit(False))
    return U.let(ipv4_to_long(ip), test)


def block_private(df: DataFrame, url_col: str = "url", dns: DataFrame | None = None) -> DataFrame:
    """Adds ``host``, ``ip`` and ``is_private``.  A literal IPv4 host is its own
    address; names are looked up in ``dns(host, ip)`` (left join); a missing
    host or a failed lookup is not private."""
    found = U.let(U.host_of(url_col), lambda h: F.struct(h.alias("host"), F.when(
        ipv4_to_long(h).isNotNull(), h).alias("ip")))
    out = df.withColumn("_h", F.explode(F.array(found)))  # parsed once
    names = [F.col(c) for c in df.columns]
    if dns is None:
        out = out.select(*names, F.col("_h.host").alias("host"), F.col("_h.ip").alias("ip"))
    else:
        d = dns.select(F.lower("host").alias("_dh"), F.col("ip").alias("_dip"))
        out = out.join(d, F.col("_h.host") == d["_dh"], "left").select(
            *names, F.col("_h.host").alias("host"), F.coalesce("_h.ip", "_dip").alias("ip"))
    return out.withColumn("is_private", is_private_ip("ip"))
