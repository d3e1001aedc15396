"""Crawl jobs as an event log (T1 batch form, T2, W4, U13).

A job is created (status running, 0 pages), then patched by progress events
(pages_cloned, max_pages, current_url), a final ``done`` (output_dir) or an
``error`` (error text).  The current record of a job is, field by field, the
latest non-NULL patch; patches to jobs that were never created are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JOB_TTL_SECONDS
from ..functions.urls import progress_pct

JOB_FIELDS = ["url", "status", "pages_cloned", "max_pages", "current_url", "output_dir", "error",
              "started_at", "created_at"]


def latest_field(field: str) -> Column:
    """max_by ignores rows whose ordering is NULL: a NULL patch never wins."""
    order = F.when(F.col(field).isNotNull(), F.struct("ts", "seq"))
    return F.max_by(F.col(field), order).alias(field)


def job_status(patches: DataFrame) -> DataFrame:
    """``patches(job_id, ts, seq, kind, <JOB_FIELDS…>)`` with ``kind`` in
    (create, update) -> one row per created job with every field at its
    latest non-NULL value and ``progress`` (U13).  A partial aggregate per
    job (no per-job sort, no collect)."""
    fields = [f for f in JOB_FIELDS if f in patches.columns]
    created = patches.where(F.col("kind") == "create").select("job_id").distinct()
    live = patches.join(created, "job_id", "left_semi")
    jobs = live.groupBy("job_id").agg(*[latest_field(f) for f in fields])
    return jobs.withColumn("progress", progress_pct("pages_cloned", "max_pages", F.col("status")))


def live_jobs(jobs: DataFrame, now, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs not older than ``ttl_seconds`` at ``now`` (prune = the rest)."""
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    cutoff = now_c - F.make_interval(secs=F.lit(ttl_seconds))
    return jobs.where(~(F.col("created_at").cast("timestamp") < cutoff))


def pruned_count(jobs: DataFrame, now, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    now_c = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    cutoff = now_c - F.make_interval(secs=F.lit(ttl_seconds))
    return jobs.agg(F.count_if(F.col("created_at").cast("timestamp") < cutoff).alias("pruned"))


def job_patches_from_events(events: DataFrame, max_pages: int = 100) -> DataFrame:
    """Job event log from an event table: one job per user and day; the first
    event creates it; view/click/signup report progress (running count of
    pages), purchase finishes it, error fails it."""
    from .policy import prefix_sum

    e = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
                      F.concat(F.col("user_id").cast("string"), F.lit("-"),
                               F.to_date("ts").cast("string")).alias("job_id"))
    is_progress = F.col("event_type").isin("view", "click", "signup")
    prog = prefix_sum(e.where(is_progress), ["job_id"], ["ts", "event_id"], out="pages_cloned")
    progress = prog.select(
        "job_id", "ts", F.col("event_id").alias("seq"), F.lit("update").alias("kind"),
        F.col("pages_cloned").cast("int").alias("pages_cloned"), F.lit(max_pages).alias("max_pages"),
        F.concat(F.lit("https://site.example.com/p/"), F.col("event_id").cast("string")).alias("current_url"))
    final = e.where(~is_progress).select(
        "job_id", "ts", F.col("event_id").alias("seq"), F.lit("update").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("cloned_sites/"), F.col("job_id")))
        .alias("output_dir"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP error "), F.col("event_id").cast("string")))
        .alias("error"))
    first = e.groupBy("job_id").agg(F.min("ts").alias("ts"), F.min_by("user_id", "ts").alias("user_id"))
    create = first.select(
        "job_id", "ts", F.lit(-1).cast("long").alias("seq"), F.lit("create").alias("kind"),
        F.concat(F.lit("https://site.example.com/u/"), F.col("user_id").cast("string")).alias("url"),
        F.lit("running").alias("status"), F.lit(0).alias("pages_cloned"), F.lit(max_pages).alias("max_pages"),
        F.lit("").alias("current_url"), F.lit("").alias("output_dir"), F.col("ts").alias("started_at"),
        F.col("ts").alias("created_at"))
    return create.unionByName(progress, allowMissingColumns=True).unionByName(final, allowMissingColumns=True)
