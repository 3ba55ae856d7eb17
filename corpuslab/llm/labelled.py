"""Bounded samples of labelled rows for fitting, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the doc_id as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: Column, most: int) -> DataFrame:
    """(doc_id, text, label long) of the labelled documents that `rows` admits, about `most` of them at most.

    Beyond that bound a hash of doc_id thins them evenly. Rows without doc_id or label are left out; of repeated labels
    the largest counts. At most about `most` small label rows are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & rows).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("long").alias("label"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(column)), F.lit(n)) < most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
