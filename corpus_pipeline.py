"""Five stages over documents; each one's result is written as Parquet and read again as the next one's documents.

toxicity drops documents scored 0.7 or more, quality those scored below 0.3; near_dedup keeps one document of each group
of near duplicates (sets of five-word shingles with a Jaccard similarity of 0.8 or more); substring_dedup cuts out byte strings of 100 or more that stand earlier; packing
lays the rest out in sequences. The models learn from the labelled rows that their queries learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import factorisation, near_copies, packing, substring_dedup, tokens, toxicity
from corpuslab.llm._shared import durable, table
from corpuslab.llm.labelled import remainder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return toxicity.without_toxic(docs, model, 0.7)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = factorisation.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return factorisation.of_quality(docs, machine, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.without_repeats(docs, length=100)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path(), size=1024)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
