"""What the operators of this package share: tables, durable cuts, lookups with hot keys and range buckets."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without the setting, a local one under a local master, and an error elsewhere."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or tempfile.mkdtemp(prefix="corpuslab-")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpuslab/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs no recomputation beyond its own tasks."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect Python's garbage (frames in a reference cycle keep their plans) and the driver's, so that Spark's cleaner deletes
    the shuffle files of plans that nothing refers to any more; twice, since the first cleaning lets go of more."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def give_back() -> None:
    """Return what this process has freed to the system: allocators keep it, and Python workers idle on for a minute."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow; at its end the worker holds no memory that it doesn't use."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called that, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lookup(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which have one row for each key and in `size` how many rows share it.

    The `HOT_KEYS` most frequent keys' facts are broadcast and their rows stay where they are; the others meet by shuffle,
    so no task holds more of one key than a `HOT_KEYS`-th of all rows. Keys are never null in facts.
    """
    hot = facts.orderBy(F.desc(size), *keys).limit(HOT_KEYS)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    taken = marked.filter("_hot").drop("_hot")
    others = marked.filter("_hot is null").select(*rows.columns).join(facts, keys, how)
    return taken.unionByName(others)


def range_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most parts - 1 ascending values that cut a long column into ranges of similar size, from a sample of about 20 keys
    a range. Only the balance depends on them, never a result."""
    if parts <= 1:
        return np.zeros(0, np.int64)
    n = df.count()
    got = np.sort(df.select(key).sample(min(1.0, 20.0 * parts / max(n, 1)), seed=7).toPandas()[key].to_numpy(np.int64))
    return np.unique(got[(np.arange(1, parts) * len(got)) // parts]) if len(got) else np.zeros(0, np.int64)


def bucket_of(key: Column, bounds: np.ndarray) -> Column:
    """The number of bounds at or below the key, by binary search; the bounds travel as an array, not as code."""
    if not len(bounds):
        return F.lit(0)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), "right").astype(np.int32))

    return place(key)
