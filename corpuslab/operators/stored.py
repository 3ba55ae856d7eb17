"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def durable(df: DataFrame, label: str) -> DataFrame:
    """df, written under spark.checkpoint.dir and read back. Without the setting a local master uses a folder of its own; any other is refused."""
    spark = df.sparkSession
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(found or tempfile.mkdtemp(prefix='corpuslab-')).rstrip('/')}/corpuslab/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
