"""Snapshots: file table, last writer per path, collisions, manifest, totals,
path map, download plan, the change classes between two crawls, and the upkeep
of a snapshot's validators from run to run (S3, S6, S7, W5, A3, A4, J6, J7,
R1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .policy import classify_asset

#: Runs in a row that may miss a URL before it leaves the snapshot.
MAX_MISSED = 3
SNAPSHOT = ["url", "etag", "last_modified", "md5", "size", "fetched_at", "missed"]


def recrawl_diff(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """``snapshot(url, etag, last_modified, md5)`` old vs new ->
    ``(url, change, request_header)`` with change in new / gone / changed /
    unchanged; the header is what a conditional request for the URL sends.
    The ETag decides when both sides have one, else Last-Modified, else the
    content hash (the validators a conditional request would send)."""
    o = old.select(key, *[F.col(c).alias("o_" + c) for c in ("etag", "last_modified", "md5")])
    n = new.select(key, *[F.col(c).alias("n_" + c) for c in ("etag", "last_modified", "md5")])
    same = (F.when(F.col("o_etag").isNotNull() & F.col("n_etag").isNotNull(), F.col("o_etag") == F.col("n_etag"))
            .when(F.col("o_last_modified").isNotNull() & F.col("n_last_modified").isNotNull(),
                  F.col("o_last_modified") == F.col("n_last_modified"))
            .otherwise(F.col("o_md5").eqNullSafe(F.col("n_md5"))))
    j = (o.withColumn("o_present", F.lit(True))
         .join(n.withColumn("n_present", F.lit(True)), key, "full_outer")
         .fillna(False, ["o_present", "n_present"]))
    change = (F.when(~F.col("o_present"), F.lit("new"))
              .when(~F.col("n_present"), F.lit("gone"))
              .when(same, F.lit("unchanged"))
              .otherwise(F.lit("changed")))
    return j.select(key, change.alias("change"), request_header("o_etag", "o_last_modified").alias("request_header"))


def request_header(etag, last_modified) -> Column:
    """The validator of a conditional request: the ETag, else the
    Last-Modified date, else none."""
    e, m = U._c(etag), U._c(last_modified)
    return (F.when(e.isNotNull() & (e != ""), F.concat(F.lit("If-None-Match: "), e))
            .when(m.isNotNull() & (m != ""), F.concat(F.lit("If-Modified-Since: "), m)))


def latest_answers(responses: DataFrame, max_asset_size: int) -> DataFrame:
    """S3: per URL the answer that counts in a run, the latest by ``attempt``
    and ``ts``: ``(url, status, outcome, etag, last_modified, md5, size,
    fetched_at)``.  ``responses(url, status, size, body or md5)`` may have
    ``etag, last_modified, attempt, ts``.  An accepted answer counts even if
    a failed attempt follows it (the file is there)."""
    have = responses.columns
    opt = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    md5 = F.col("md5") if "md5" in have else F.md5("body")
    outcome = classify_asset("status", "size", max_asset_size=max_asset_size)
    rows = responses.select(
        "url", F.col("status").cast("int").alias("status"), outcome.alias("outcome"),
        F.when(opt("etag", "string") != "", opt("etag", "string")).alias("etag"),
        F.when(opt("last_modified", "string") != "", opt("last_modified", "string")).alias("last_modified"),
        md5.alias("md5"), F.col("size").cast("long").alias("size"), opt("ts", "timestamp").alias("fetched_at"),
        opt("attempt", "int").alias("attempt"))
    rank = F.struct(F.col("outcome").isin("accept", "unchanged").alias("ok"), F.col("attempt").alias("n"),
                    F.col("fetched_at").alias("t"), F.col("md5").alias("tie"))
    cols = ["status", "outcome", "etag", "last_modified", "md5", "size", "fetched_at"]
    return rows.groupBy("url").agg(F.max_by(F.struct(*cols), rank).alias("a")).select("url", "a.*")


def merge_snapshot(old: DataFrame | None, answers: DataFrame, max_missed: int = MAX_MISSED) -> DataFrame:
    """The snapshot after a run: ``SNAPSHOT`` columns and ``change``.

    ``old`` has the ``SNAPSHOT`` columns (``missed`` and the validators may be
    missing: 0 and NULL), ``answers`` those of ``latest_answers``; both hold a
    URL once.  Full outer merge by URL:

    - accepted: the answer's validators, hash, size and time; ``new``,
      ``changed``, or ``unchanged`` if the hash is the old one;
    - 304: the old row goes on; a validator that the 304 gives replaces the
      old one; ``unchanged``.  Without an old row there is nothing to carry;
    - 404, 410 or no answer at all: ``gone``; the old row goes on with
      ``missed`` one higher and leaves once that is over ``max_missed``;
    - any other answer (429, 5xx, too large, empty): ``kept`` as it was;
      without an old row nothing is known of the URL."""
    a = answers.select("url", F.lit(True).alias("_asked"), *[F.col(c).alias("n_" + c) for c in (
        "status", "outcome", "etag", "last_modified", "md5", "size", "fetched_at")])
    if old is None:
        o = answers.limit(0).select("url", "etag", "last_modified", "md5", "size", "fetched_at",
                                    F.lit(0).alias("missed"))
    else:
        o = old
    types = {"etag": "string", "last_modified": "string", "md5": "string", "size": "long", "fetched_at": "timestamp"}
    o = o.select("url", F.lit(True).alias("_held"), *[
        (F.col(c).cast(t) if c in o.columns else F.lit(None).cast(t)).alias("o_" + c) for c, t in types.items()],
        (F.coalesce("missed", F.lit(0)).cast("int") if "missed" in o.columns else F.lit(0)).alias("o_missed"))
    j = o.join(a, "url", "full_outer")
    held, asked = F.coalesce("_held", F.lit(False)), F.coalesce("_asked", F.lit(False))
    accepted = asked & (F.col("n_outcome") == "accept")
    same = asked & (F.col("n_outcome") == "unchanged")
    gone = ~asked | F.col("n_status").isin(404, 410)
    change = (F.when(accepted & ~held, "new")
              .when(accepted & F.col("o_md5").eqNullSafe(F.col("n_md5")), "unchanged")
              .when(accepted, "changed").when(~held, None).when(same, "unchanged").when(gone, "gone").otherwise("kept"))
    validator = lambda c: (F.when(accepted, F.col("n_" + c)).when(same, F.coalesce("n_" + c, "o_" + c))
                           .otherwise(F.col("o_" + c))).alias(c)
    value = lambda c: F.when(accepted, F.col("n_" + c)).otherwise(F.col("o_" + c)).alias(c)
    missed = F.when(accepted | same, 0).when(gone, F.col("o_missed") + 1).otherwise(F.col("o_missed"))
    out = j.select("url", validator("etag"), validator("last_modified"), value("md5"), value("size"),
                   value("fetched_at"), missed.alias("missed"), change.alias("change"))
    return out.where(F.col("change").isNotNull() & (F.col("missed") <= max_missed))


def conditional_requests(plan: DataFrame, snapshot: DataFrame, url_col: str = "abs_url") -> DataFrame:
    """``plan`` with the ``request_header`` that asks whether the file of
    the snapshot is still the current one (NULL: an ordinary request)."""
    held = snapshot.select(F.col("url").alias(url_col), request_header("etag", "last_modified").alias("request_header"))
    return plan.join(held, url_col, "left")


def plan_downloads(assets: DataFrame, snapshot: DataFrame | None = None, keys: list[str] | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """J7 + A2: distinct asset URLs per crawl with the first content-type hint,
    minus those already downloaded (``snapshot(abs_url)``) and ``data:`` URLs."""
    keys = list(keys or ["crawl_id"])
    order = list(order or ["crawl_rank", "tag_rank", "tag_pos", "attr_rank", "srcset_idx"])
    o = F.struct(*order)
    d = (assets.where(~F.col("abs_url").startswith("data:"))
         .groupBy(*keys, "abs_url")
         .agg(F.min_by(F.struct("content_type", "is_stylesheet"), o).alias("f"), F.min(o).alias("first_ref"))
         .select(*keys, "abs_url", "f.content_type", "f.is_stylesheet", "first_ref"))
    if snapshot is not None:
        d = d.join(snapshot.select(F.col("url").alias("abs_url")).distinct(), "abs_url", "left_anti")
    return d


def path_map(refs: DataFrame, answers: DataFrame | None = None, homes: DataFrame | None = None,
             whole: bool = False) -> DataFrame:
    """A3: ``refs(crawl_id, url, content_type, seq)`` -> ``(crawl_id, url,
    local_path)`` of the URLs that are not stored where the URL alone says:
    their first reference's content-type hint decides, or, with
    ``answers(url, content_type)``, the type that the server answered where
    no reference gives a hint; with ``homes(crawl_id, seed_netloc)``, files of other
    authorities than the crawl's lie below ``_external/<authority>/``.
    ``whole``: all URLs, also those whose path is their own."""
    first = refs.groupBy("crawl_id", "url").agg(F.min_by("content_type", "seq").alias("content_type"))
    if answers is not None:
        said = answers.groupBy("url").agg(F.max("content_type").alias("_said"))
        first = first.join(said, "url", "left").withColumn("content_type", F.coalesce("content_type", "_said")).drop("_said")
    if homes is None:
        first = first if whole else first.where(F.col("content_type").isNotNull())
        path = U.file_path(F.col("url"), F.col("content_type"))
    else:
        first = first.join(homes.select("crawl_id", "seed_netloc").distinct(), "crawl_id")
        path = U.external_path(F.col("url"), F.col("content_type"), F.col("seed_netloc"))
    named = first.select("crawl_id", "url", path.alias("local_path"), U.file_path(F.col("url")).alias("_plain"))
    return (named if whole else named.where(F.col("local_path") != F.col("_plain"))).drop("_plain")


def last_writer(files: DataFrame, keys: list[str] | None = None, order: str = "write_seq") -> DataFrame:
    """One file per (crawl, local_path): the last write wins.  A partial
    aggregate (max_by) per path, so a hot path is combined map-side."""
    keys = list(keys or ["crawl_id"])
    rest = [c for c in files.columns if c not in keys + ["local_path"]]
    return (files.groupBy(*keys, "local_path")
            .agg(F.max_by(F.struct(*rest), F.col(order)).alias("w"))
            .select(*keys, "local_path", "w.*"))


def collision_report(files: DataFrame, keys: list[str] | None = None, order: str = "write_seq") -> DataFrame:
    """All writers of each path that more than one URL writes: ``(*keys,
    local_path, source_url, writers, won)``; ``won`` marks the one that W5
    keeps.  A URL that writes a path repeatedly is one writer.  Rows stay
    rows: a path that a third of all URLs write is no list in one row."""
    keys = [*(keys or ["crawl_id"]), "local_path"]
    each = files.groupBy(*keys, "source_url").agg(F.max(order).alias("_last"))
    paths = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("writers"), F.max_by("source_url", "_last").alias("_winner"))
    return each.join(paths.where("writers > 1"), keys).select(
        *keys, "source_url", "writers", F.col("source_url").eqNullSafe(F.col("_winner")).alias("won"))


def manifest(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sorted listing with size and MD5 of every file."""
    keys = list(keys or ["crawl_id"])
    return (files.select(*keys, "local_path", F.octet_length("content").cast("long").alias("size"),
                         F.md5("content").alias("md5"), "kind")
            .orderBy(*keys, "local_path"))


def site_totals(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A4: files and bytes per crawl."""
    keys = list(keys or ["crawl_id"])
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"),
                                    F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def write_site(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the snapshot as parquet partitioned by crawl.  With
    ``overwrite`` only the crawls that ``files`` holds are replaced; other
    crawls below ``path`` stay."""
    (files.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(path))
