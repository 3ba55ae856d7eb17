"""An append-only ledger of outcomes as a stream: each key is taken once, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def outcomes(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """New JSON files of a folder as they come."""
    return spark.readStream.schema(schema).json(folder)


def first_outcomes(stream: DataFrame, key: str, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column, keys older than the delay are forgotten, which bounds the state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if at else stream.dropDuplicates([key])


def append(stream: DataFrame, path: str, checkpoint: str):
    """Everything there is, appended as JSON lines; run again, it goes on where it ended."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
