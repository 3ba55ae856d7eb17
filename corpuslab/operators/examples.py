"""Labelled examples made from aligned pairs, and rows that take their state from rows before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label(score: float, severity: str, rationale: str) -> Column:
    """The compact JSON of a label."""
    return F.to_json(F.struct(F.lit(score).alias("score"), F.lit(severity).alias("severity"), F.lit(rationale).alias("rationale")))


def _words(c: Column) -> Column:
    return F.split(c, " ")


def truncated(c: Column) -> Column:
    """The first half of the words, one at least."""
    w = _words(c)
    return F.array_join(F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int"))), " ")


def repeated_tail(c: Column, n: int = 3) -> Column:
    """The text and its last words again."""
    w = _words(c)
    return F.concat_ws(" ", c, F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - (n - 1)), n), " "))


def verifier_examples(pairs: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Each pair as right, copied, cut, leaking, repeated, taken from another pair and mixed with one: candidate and label.

    The other target is the next different one in order, the first following the last, so no pair needs all others.
    """
    w = W.partitionBy(*(k for k in keys[:1])).orderBy(*order)
    other = F.coalesce(F.lead("target").over(w), F.first("target").over(w))
    df = pairs.withColumn("_other", F.when(other != F.col("target"), other))
    half = truncated(F.col("target"))
    made = [
        (F.col("target"), label(0.98, "none", "faithful_reference_translation")),
        (F.col("source"), label(0.02, "critical", "copied_spanish_source")),
        (half, label(0.38, "major", "incomplete_translation")),
        (F.concat("target", F.lit(" de la autoridad")), label(0.58, "major", "spanish_leakage")),
        (repeated_tail(F.col("target")), label(0.72, "minor", "repetition_or_fluency_damage")),
        (F.col("_other"), label(0.16, "critical", "fluent_but_semantically_unrelated_chanka")),
        (F.when(F.col("_other").isNotNull(), F.concat_ws(" ", half, truncated(F.col("_other")))), label(0.42, "major", "mixed_translation_from_another_example")),
    ]
    rows = F.filter(F.array(*(F.struct(c.alias("candidate"), v.alias("label")) for c, v in made)), lambda x: x["candidate"].isNotNull())
    return df.select(*keys, F.posexplode(rows).alias("variant", "e")).select(*keys, "variant", "e.candidate", "e.label")


def filled_down(df: DataFrame, keys: list[str], order: list, column: str) -> DataFrame:
    """column, where it is null or blank taken from the nearest row before that has it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = F.when(F.trim(column) != "", F.col(column))
    return df.withColumn(column, F.last(own, ignorenulls=True).over(w))


def chunked(df: DataFrame, keys: list[str], order: list, size: int) -> DataFrame:
    """chunk and place: rows of a key in runs of `size`."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumns({"chunk": F.floor(F.col("_n") / size), "place": F.pmod(F.col("_n"), F.lit(size))}).drop("_n")


def has_adjacent_repeat(tokens: Column) -> Column:
    """Whether a token stands twice in a row."""
    return F.exists(F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"])
