"""Structured Streaming forms of the long-lived state.

A stream writes through ``foreachBatch`` into a table of one folder per epoch.
An epoch that is replayed after a failure writes the same folder again, so no
row is doubled; the stream's own checkpoint lies beside the table, so a stream
that is started again with the same path goes on where it stopped.
``run_available`` drives a stream with ``availableNow``; a live deployment
uses a processing-time trigger instead.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import BURST, JOB_TTL_SECONDS, RATE_PER_SEC
from ..functions import urls as U
from ..functions.urls import progress_pct
from ..operators import extract as X
from ..operators.jobs import JOB_FIELDS, latest_field, live_jobs
from ..operators.policy import token_bucket
from ..session import remove, scratch_path


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """A parquet table of a folder of tables as a file stream."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, sf_dir, path)))


def _folder_of(spark: SparkSession, sf_dir: str, path: str) -> str:
    """A file stream reads folders: a table that is a single file is reached by a glob on its own name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(p).isDirectory() else path[:-1] + "[" + path[-1] + "]"


def read_epochs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that a stream wrote, with the ``epoch`` of each row; empty before the first epoch."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    full = StructType(schema.fields).add("epoch", "long")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{path}/table")


def run_available(df: DataFrame, name: str, mode: str = "append", path: str | None = None,
                  each: Callable[[DataFrame, int, str], DataFrame] | None = None,
                  schema: StructType | None = None) -> DataFrame:
    """Run a streaming DataFrame over all that is there now; returns the table
    (``append``: all rows; ``update``: the rows of all epochs, see ``latest``).
    ``path`` names the table for restarts; ``each`` maps a batch to the rows
    that are written (of ``schema``)."""
    spark = df.sparkSession
    path = path or scratch_path(spark, f"stream-{name}")

    def sink(batch: DataFrame, epoch: int) -> None:
        rows = each(batch, epoch, path) if each else batch
        rows.write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")

    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_epochs(spark, path, schema or df.schema)


def latest(table: DataFrame, key: str) -> DataFrame:
    """The last written row of each key of an ``update`` stream's table."""
    rest = [c for c in table.columns if c not in (key, "epoch")]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(key, "r.*")


# ---------------------------------------------------------------------------
# T1 job status over a live stream of patches, T2
# ---------------------------------------------------------------------------

def job_status_stream(patches: DataFrame) -> DataFrame:
    """The streaming form of ``jobs.job_status`` on the same patch schema
    (update mode): per job each field's latest non-NULL patch.  ``created``
    tells whether the job's create event has arrived; see ``job_table``."""
    fields = [f for f in JOB_FIELDS if f in patches.columns]
    return patches.groupBy("job_id").agg(
        F.max(F.col("kind") == "create").alias("created"), *[latest_field(f) for f in fields])


def job_table(table: DataFrame, now=None, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """The current records of a ``job_status_stream`` table: patches to jobs
    that were never created are left out and, with ``now``, so are jobs older
    than the time to live."""
    jobs = latest(table, "job_id").where("created").drop("created")
    jobs = jobs.withColumn("progress", progress_pct("pages_cloned", "max_pages", F.col("status")))
    return jobs if now is None else live_jobs(jobs, now, ttl_seconds)


class ExpiringJobs(NamedTuple):
    """T2 on a stream: its patches, how far the watermark of ``ts`` is behind the newest one, and the time to live."""
    patches: DataFrame
    delay: str
    ttl_seconds: int


def expiring_jobs(patches: DataFrame, delay: str, ttl_seconds: int = JOB_TTL_SECONDS) -> ExpiringJobs:
    """``job_status_stream`` with state that ends.  Per job the fields'
    latest non-NULL patches are keyed state; an event-time timer at the job's
    creation plus the time to live clears it and emits the job once more with
    ``expired``.  Time is the watermark of ``ts`` (``delay`` behind the newest
    patch); later patches of an ended job begin a record that nobody created,
    which ends the same way.  ``live_job_table`` keeps state and timers."""
    return ExpiringJobs(patches, delay, ttl_seconds)


_MARKS = StructType().add("before", "long").add("mark", "long")


def live_job_table(jobs: ExpiringJobs, name: str, path: str | None = None) -> DataFrame:
    """The jobs of an ``expiring_jobs`` stream that have not ended.  Reading
    it takes no clock.  The stream's own table lists per epoch the jobs that
    were touched and, as ``expired``, those that ended.

    State is a table that each epoch writes whole: of each field the latest
    value with its (ts, seq, epoch), and when the job's timer fires.  An epoch
    joins its patches to it by one aggregate per job, which begins before the
    shuffle; a timer is a column, so that all of an epoch fire in one scan.
    As in the engine, an epoch's timers fire after its patches, by the
    watermark of the epochs before it; patches are late by the watermark that
    the epoch before was run with; and when no more patches come, the timers
    up to the last watermark fire as well (``settled``)."""
    spark, fields = jobs.patches.sparkSession, [f for f in JOB_FIELDS if f in jobs.patches.columns]
    path = path or scratch_path(spark, f"stream-{name}")
    at = lambda kind, e: f"{path}/{kind}/epoch={e}"
    place = StructType().add("ts", "long").add("seq", "long").add("epoch", "long")
    schema = StructType().add("job_id", jobs.patches.schema["job_id"].dataType).add("created", "boolean").add("ends", "long")
    for f in fields:
        schema.add(f, jobs.patches.schema[f].dataType).add(f"{f}_at", place)
    written = StructType(schema.fields).add("touched", "boolean").add("ended", "boolean")

    def marks(e):
        return spark.read.schema(_MARKS).parquet(at("marks", e)).first()

    def held(e):
        return spark.read.schema(written).parquet(at("jobs", e)).where("NOT ended")

    def each(batch: DataFrame, epoch: int, root: str) -> DataFrame:
        before, mark = marks(epoch - 1) if epoch else (0, 0)
        rows = batch.withColumn("_us", F.unix_micros("ts"))
        late = before
        if epoch and epoch - 1 in _epochs(spark, f"{path}/settled"):
            late = mark
        of = lambda f: F.when(F.col(f).isNotNull(), F.struct(
            F.col("_us").alias("ts"), F.col("seq").cast("long").alias("seq"), F.lit(epoch).cast("long").alias("epoch")))
        rows = rows.where(~F.coalesce(F.col("_us") <= late * 1000, F.lit(False))).select(
            "job_id", (F.col("kind") == "create").alias("created"), F.lit(None).cast("long").alias("ends"),
            *[c for f in fields for c in (F.col(f), of(f).alias(f"{f}_at"))], F.col("_us").alias("_first"), F.lit(True).alias("touched"))
        if epoch:
            old = held(epoch - 1)
            if late == mark:  # their timers have fired, where the stream had no more to give
                old = old.where(F.coalesce(F.col("ends") >= mark, F.lit(True)))
            rows = rows.unionByName(old.select(*schema.names, F.lit(None).cast("long").alias("_first"), F.lit(False).alias("touched")))
        now = rows.groupBy("job_id").agg(
            F.coalesce(F.max("created"), F.lit(False)).alias("created"), F.max("ends").alias("_ends"),
            F.min("_first").alias("_first"), F.max("touched").alias("touched"),
            *[c for f in fields for c in (F.max_by(f, f"{f}_at").alias(f), F.max(f"{f}_at").alias(f"{f}_at"))])
        # a job lives from its creation on, patches to a job that nobody creates from the first one of the epoch on
        first = F.floor(F.col("_first") / 1000)
        begun = F.coalesce(F.unix_millis(F.col("created_at").cast("timestamp")), first) if "created_at" in fields else first
        now = now.withColumn("ends", F.when(F.col("touched"), begun + jobs.ttl_seconds * 1000).otherwise(F.col("_ends")).cast("long"))
        now = now.withColumn("ended", F.coalesce(F.col("ends") < mark, F.lit(False)))
        now.select(*written.names).write.mode("overwrite").parquet(at("jobs", epoch))
        newest = batch.agg(F.unix_millis((F.max("ts") - F.expr(f"INTERVAL {jobs.delay}")).cast("timestamp"))).first()[0]
        spark.createDataFrame([(mark, max(mark, mark if newest is None else newest))], _MARKS).coalesce(1).write.mode(
            "overwrite").parquet(at("marks", epoch))
        if epoch > 1:  # the one before the last is needed by no replay
            for kind in ("jobs", "marks", "settled"):
                remove(spark, at(kind, epoch - 2))
        # of a job that was patched and ended in one epoch the end counts
        return spark.read.schema(written).parquet(at("jobs", epoch)).where("created AND (touched OR ended)").select(
            "job_id", F.col("ended").alias("expired"))

    out = StructType().add("job_id", schema["job_id"].dataType).add("expired", "boolean")
    run_available(jobs.patches, name, "append", path, each, out)
    epochs = _epochs(spark, f"{path}/jobs")
    if not epochs:
        return spark.createDataFrame([], StructType([f for f in schema.fields if f.name == "job_id" or f.name in fields]))
    last = max(epochs)
    mark = marks(last)["mark"]
    created = held(last).where("created")
    if last not in _epochs(spark, f"{path}/settled"):
        created.where(F.col("ends") < mark).select("job_id", F.lit(True).alias("expired")).write.mode("append").parquet(
            f"{path}/table/epoch={last}")
        spark.createDataFrame([(mark, mark)], _MARKS).coalesce(1).write.mode("overwrite").parquet(at("settled", last))
    return created.where(F.coalesce(F.col("ends") >= mark, F.lit(True))).select("job_id", *fields)


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The epochs that have a folder below ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(x.getPath().getName().rpartition("=")[2]) for x in fs.listStatus(p)] if fs.exists(p) else []


# ---------------------------------------------------------------------------
# T3 visited set over a live page stream
# ---------------------------------------------------------------------------

def streaming_frontier(pages: DataFrame, watermark: str | None = None) -> DataFrame:
    """Links of arriving pages, each normalised URL emitted once.
    Without a watermark the dedupe state holds every URL seen; with
    ``watermark`` (on an event-time column ``ts``) it is bounded."""
    links = X.extract_links(pages, base_col="url", keep=["ts"] if watermark else None)
    out = links.select("norm_url", U.authority("norm_url").alias("host"), *(["ts"] if watermark else []))
    if watermark:
        return out.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["norm_url"])
    return out.dropDuplicates(["norm_url"])


# ---------------------------------------------------------------------------
# T4 token bucket per host with arrivals
# ---------------------------------------------------------------------------

BUCKET = StructType().add("event_id", "long").add("host", "string").add("arrival", "double") \
    .add("start_at", "double").add("wait_s", "double")
BUCKET_STATE = StructType().add("host", "string").add("seen", "long").add("peak", "double")


def token_bucket_stream(requests: DataFrame, name: str, rate: float = RATE_PER_SEC, burst: int = BURST,
                        path: str | None = None) -> DataFrame:
    """T4 over a stream ``requests(event_id, host, arrival)``: each batch is
    scheduled by ``policy.token_bucket``, in which a hot host spans many
    tasks; what is carried over is two numbers per host, as a table per
    epoch.  A batch's requests are taken to come after those of the earlier
    batches."""
    def each(batch: DataFrame, epoch: int, root: str) -> DataFrame:
        spark = batch.sparkSession
        at = lambda e: f"{root}/state/epoch={e}"
        state = spark.read.schema(BUCKET_STATE).parquet(at(epoch - 1)) if epoch else None
        starts, new = token_bucket(batch, state, rate, burst)
        new.write.mode("overwrite").parquet(at(epoch))
        if epoch > 1:  # the one before the last is needed by no replay
            remove(spark, at(epoch - 2))
        return starts.select(*BUCKET.names)

    return run_available(requests, name, each=each, path=path, schema=BUCKET).drop("epoch")


BUCKET_LATE = StructType(BUCKET.fields).add("late", "boolean")
_REQUEST = StructType(BUCKET.fields[:3])


def token_bucket_reordered(requests: DataFrame, name: str, delay_s: float, rate: float = RATE_PER_SEC, burst: int = BURST,
                           path: str | None = None) -> DataFrame:
    """T4 over a stream whose requests arrive out of order, within and across
    batches.  Requests wait in a table until the watermark (``delay_s`` behind
    the newest arrival) has passed them and are then scheduled in order of
    arrival by ``policy.token_bucket``; a request behind the watermark when it
    comes can not be put in its place any more and is listed as ``late``, with
    no start.  So arrivals in any order give what one batch of all that are
    not late gives.  What waits when the stream has no more to give is
    scheduled in the returned table, and still waits if the stream goes on.

    Carried over per epoch: two numbers a host, the waiting requests (those of
    ``delay_s`` and the newest batch), the watermark; all tables, so that a hot host spans
    many tasks."""
    spark = requests.sparkSession
    path = path or scratch_path(spark, f"stream-{name}")
    at = lambda kind, e: f"{path}/{kind}/epoch={e}"
    mark_schema = StructType().add("mark", "double")

    def held(kind, e, schema):
        return spark.read.schema(schema).parquet(at(kind, e))

    def late_rows(rows):
        return rows.select("event_id", "host", "arrival", F.lit(None).cast("double").alias("start_at"),
                           F.lit(None).cast("double").alias("wait_s"), F.lit(True).alias("late"))

    def each(batch: DataFrame, epoch: int, root: str) -> DataFrame:
        rows = batch.select("event_id", "host", F.col("arrival").cast("double").alias("arrival"))
        old = held("mark", epoch - 1, mark_schema).first()["mark"] if epoch else None
        newest = rows.agg(F.max("arrival")).first()[0]
        mark = max((m for m in (old, None if newest is None else newest - delay_s) if m is not None), default=None)
        late = rows.where(F.col("arrival") <= old) if old is not None else rows.limit(0)
        rows = rows.where(F.col("arrival") > old) if old is not None else rows
        if epoch:
            rows = rows.unionByName(held("waiting", epoch - 1, _REQUEST))
        passed = F.lit(False) if mark is None else F.col("arrival") <= mark
        starts, state = token_bucket(rows.where(passed), held("state", epoch - 1, BUCKET_STATE) if epoch else None, rate, burst)
        state.write.mode("overwrite").parquet(at("state", epoch))
        rows.where(~passed).write.mode("overwrite").parquet(at("waiting", epoch))
        spark.createDataFrame([(mark,)], mark_schema).coalesce(1).write.mode("overwrite").parquet(at("mark", epoch))
        if epoch > 1:
            for kind in ("state", "waiting", "mark"):
                remove(spark, at(kind, epoch - 2))
        return starts.withColumn("late", F.lit(False)).select(*BUCKET_LATE.names).unionByName(late_rows(late))

    done = run_available(requests, name, each=each, path=path, schema=BUCKET_LATE).drop("epoch")
    epochs = _epochs(spark, f"{path}/waiting")
    if not epochs:
        return done
    rest, _ = token_bucket(held("waiting", max(epochs), _REQUEST), held("state", max(epochs), BUCKET_STATE), rate, burst)
    return done.unionByName(rest.withColumn("late", F.lit(False)).select(*BUCKET_LATE.names))
