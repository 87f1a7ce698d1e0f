"""A folder into which files are dropped, read as a stream: each micro-batch's files go through the same readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablemill.sources.files import read_sheets

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return read_sheets(spark.readStream.format("binaryFile").schema(FILES).load(path))


def watch(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run each(rows, batch) over the files that came since the last batch, then stop; the checkpoint remembers them."""
    return read_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
