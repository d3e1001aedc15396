"""SparkSession helpers: defaults for tests and bench, and tables in the shared
folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # URL and markup operators are thousands of Column calls; recording the Python line of each takes most of the time that
    # it takes to build a plan (a static setting: a cluster job sets it when it makes its session)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "mirrorframe") -> SparkSession:
    """Build (or reuse) a session.  Only used by tests, bench and examples; a
    cluster job should pass its own session to the operators."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("MIRRORFRAME_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream state: the cluster's
    ``spark.checkpoint.dir``.  Only in local mode, where one machine is all
    there is, a scratch folder is made when the setting is unset."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="mirrorframe-ckpt-")
        sc.setCheckpointDir(d)
    # iterative plans carry large expressions; keep their text form bounded
    if spark.conf.get("spark.sql.maxPlanStringLength", "2147483632") == "2147483632":
        spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Lineage cuts as tables in the shared folder, which outlive any executor.
    A ``table`` is removed when the block ends; a ``keep`` stays, because the
    returned result reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self._gone = spark, scratch_path(spark, name), []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        for path in self._gone:
            remove(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex[:8]}"
        self._gone.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
