"""Helpers shared by the operators: scratch tables in the shared folder, columns by name, stable row order."""
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13, which is also what bytes.split() splits on.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where it is unset a folder of this machine is set, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written into the shared folder, so that no later step depends on what an executor holds.

    ``keep`` writes a table that the returned result still reads.  ``table`` writes one that goes when the block ends.
    Before either, and at the end, the shuffle files of the steps behind it are let go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.gone = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for label in list(self.gone):
            self.drop(label)
        self._release()

    def drop(self, label: str) -> None:
        """Removes the tables of a label before the block ends."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.gone.pop(label, []):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def path(self, label: str) -> str:
        return f"{self.root}/{label}-{uuid.uuid4().hex[:8]}"

    def _release(self) -> None:
        """Lets the driver drop the shuffle files of finished steps, to which nothing refers any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        self._release()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        return self._write(df, self.path(label))

    def table(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        self.gone.setdefault(label, []).append(path)
        return self._write(df, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

