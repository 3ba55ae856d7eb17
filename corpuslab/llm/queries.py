"""The thin queries over the operators of this package, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import durable, fresh_path, release, table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seeds=(42,), distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents"), length=100).drop("digest", "kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import default_path, round_trip

    return round_trip(table(spark, sf_dir, "documents"), default_path())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_ratio import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=-0.1).drop("score")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .editprint import compared_with_next, with_classes

    compared = durable(compared_with_next(table(spark, sf_dir, "documents")), "compared")
    release(spark)  # the texts' shuffle goes before the bands' comes
    return with_classes(compared)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokens import default_path

    return pack(table(spark, sf_dir, "documents"), default_path(), size=1024, end_id=0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import remainder
    from .toxicity import fit, score

    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .huffman import read_tokens, write_tokens
    from .tokens import default_path

    path = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, default_path(), end_id=0)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .factorisation import fit, score
    from .labelled import remainder

    docs, held = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 0
    machine = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return score(docs, machine).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op1_html_text": op1_html_text, "op2_suffix_dedup": op2_suffix_dedup, "op3_sentencepiece": op3_sentencepiece, "op4_quality_rules": op4_quality_rules, "op5_fingerprints": op5_fingerprints, "op6_packing": op6_packing, "op7_toxicity": op7_toxicity, "op8_simhash": op8_simhash, "op9_token_files": op9_token_files, "op10_quality_classifier": op10_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
