"""Cutting lineage through shared storage, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's ``spark.checkpoint.dir``, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="isovane-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """Tables between the steps of a job: each is written to the shared checkpoint folder and read back.

    Columns that a step doesn't read stay on disk, and a step's plan never holds the steps before it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.top = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4()}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        """``df`` as a stored table; the one that was put before the last goes: nothing reads it any more."""
        self.count += 1
        path = f"{self.top}/{self.count}"
        df.write.parquet(path)
        self._delete(f"{self.top}/{self.count - 1}")
        return self.spark.read.parquet(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
