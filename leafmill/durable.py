"""Cutting lineage with tables in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary one is used if all runs on this machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if top := spark.conf.get("spark.checkpoint.dir", None):
        return top
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation in the shared folder; each can go as soon as the next is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top = spark, checkpoint_folder(spark)
        self.tables: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame) -> DataFrame:
        """Writes the rows and reads them back: columnar, so later steps read just the columns that they use."""
        path = f"{self.top}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        atexit.register(_drop, self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Drops these; without any, all."""
        for table, path in [x for x in self.tables if not tables or any(x[0] is t for t in tables)]:
            _drop(self.spark, path)
            self.tables.remove((table, path))


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back; the files go when this process ends, or with the folder."""
    return Scratch(df.sparkSession).put(df)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass
