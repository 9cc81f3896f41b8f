"""Files as they arrive: each new file is scanned once and its rows are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], pattern: str = "*") -> StreamingQuery:
    """Reads files(path, content) below source and appends parse(files) to Parquet under target, one folder for each micro-batch, so that a
    batch that runs again after a failure replaces its own output."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY").load(source)

    def write(batch: DataFrame, number: int) -> None:
        parse(batch.select("path", "content")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
