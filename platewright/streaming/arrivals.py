"""File-arrival streams: counts of what has come into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Stream of the Parquet files that arrive in `folder`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def drain(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Run `write` on every batch that is there now, then stop; a rerun takes up where it ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
