"""Job store semantics (create / patch / unknown job / TTL), as a batch and as a
stream, and the token bucket against a simulation in small time steps."""
import datetime as dt

from pyspark.sql import functions as F

from mirrorframe.operators.jobs import job_status, live_jobs, pruned_count
from mirrorframe.streaming.live import job_status_stream, job_table, run_available, token_bucket_stream


def test_job_patches(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("j1", t0, -1, "create", "running", 0, 100, "", None, t0),
            ("j1", t0 + dt.timedelta(seconds=1), 1, "update", None, 1, 100, "http://a/1", None, None),
            ("j1", t0 + dt.timedelta(seconds=2), 2, "update", None, 2, 100, "http://a/2", None, None),
            ("j1", t0 + dt.timedelta(seconds=3), 3, "update", "done", None, None, None, None, None),
            ("j2", t0, -1, "create", "running", 0, 50, "", None, t0 - dt.timedelta(hours=2)),
            ("j2", t0 + dt.timedelta(seconds=5), 1, "update", "error", None, None, None, "boom", None),
            ("ghost", t0, 1, "update", "done", 9, 9, "x", None, None)]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, seq long, kind string, status string, "
                                     "pages_cloned int, max_pages int, current_url string, error string, "
                                     "created_at timestamp")
    jobs = {r.job_id: r for r in job_status(df).collect()}
    assert set(jobs) == {"j1", "j2"}  # patch to an unknown job is ignored
    assert (jobs["j1"].status, jobs["j1"].pages_cloned, jobs["j1"].current_url, jobs["j1"].progress) == (
        "done", 2, "http://a/2", 100)
    assert (jobs["j2"].status, jobs["j2"].error, jobs["j2"].progress) == ("error", "boom", 0)
    now = "2024-01-01 00:30:00"
    assert [r.job_id for r in live_jobs(job_status(df), now).collect()] == ["j1"]
    assert pruned_count(job_status(df), now).first().pruned == 1

    # the same patches as a stream of several files, stopped half way and started again
    path, out = str(tmp_path / "patches"), str(tmp_path / "jobs")
    stream = lambda: job_status_stream(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    for part in (df.where("ts < '2024-01-01 00:00:02'"), df.where("ts >= '2024-01-01 00:00:02'")):
        part.repartition(2).write.mode("append").parquet(path)
        table = run_available(stream(), "jobs", mode="update", path=out)
    assert sorted(map(tuple, job_table(table).select(*job_status(df).columns).collect())) == sorted(
        map(tuple, job_status(df).collect()))
    assert [r.job_id for r in job_table(table, now).collect()] == ["j1"]


def test_empty_stream_and_replayed_epoch(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([], "a long").write.parquet(path)
    stream = lambda: spark.readStream.schema("a long").parquet(path)
    out = str(tmp_path / "out")
    assert run_available(stream(), "empty", path=out).count() == 0
    spark.createDataFrame([(1,), (2,)], "a long").write.mode("append").parquet(path)
    assert run_available(stream(), "empty", path=out).count() == 2
    # an epoch that is written again replaces itself
    first = sorted(p.name for p in (tmp_path / "out" / "table").iterdir())[-1]
    spark.createDataFrame([(1,), (2,)], "a long").write.mode("overwrite").parquet(f"{out}/table/{first}")
    assert run_available(stream(), "empty", path=out).count() == 2


def test_token_bucket_stream_matches_simulation(spark, tmp_path):
    arrivals = [("h1", i, i * 0.01) for i in range(60)] + [("h2", 100 + i, 5.0 + i) for i in range(5)] + [(None, 200, 1.0)]
    path = str(tmp_path / "req")
    df = spark.createDataFrame(arrivals, "host string, event_id long, arrival double")
    stream = lambda: spark.readStream.schema(df.schema).parquet(path)
    for part in (df.where("arrival < 0.25"), df.where("arrival >= 0.25")):  # two runs: the state is carried over
        part.write.mode("append").parquet(path)
        table = token_bucket_stream(stream(), "tb", path=str(tmp_path / "out"))
    got = {r.event_id: r.start_at for r in table.collect()}
    assert len(got) == len(arrivals)
    step = 0.0005
    for host in ("h1", "h2", None):
        tokens, now, waiting = 20.0, 0.0, sorted((a, e) for h, e, a in arrivals if h == host)
        while waiting:
            while waiting and waiting[0][0] <= now + 1e-9 and tokens >= 1 - 1e-9:
                assert abs(got[waiting[0][1]] - max(now, waiting[0][0])) < 2 * step
                tokens -= 1
                waiting.pop(0)
            now, tokens = now + step, min(20.0, tokens + step * 10)
