"""New PDF files as a stream of opened rows (stateless; layout is per page and runs in foreachBatch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pdf import Documents, open_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(path)
    return found.select(F.col("path").alias("file_id"), "content")


def stream_opened(spark: SparkSession, path: str) -> DataFrame:
    return open_files(stream_files(spark, path))


def each_batch(use: Callable[[Documents, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: hands over the tables of the batch's files."""
    return lambda files, n: use(Documents(files), n)
