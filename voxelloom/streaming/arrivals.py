"""File arrival: new image files become volume rows, exactly once per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).load(folder)


def store_new(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the names of new files; the checkpoint makes reruns idempotent."""
    return files.select("path", "length", "modificationTime").writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
