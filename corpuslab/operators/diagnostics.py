"""Diagnostics of structured answers and labels: rates and means over many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, rewards
from ..functions import text as T


def _rate(test: Column) -> Column:
    return 100.0 * F.coalesce(F.avg(test.cast("int")), F.lit(0.0))


def self_verification(df: DataFrame, keys: list[str], answer: str, need_thought: bool = False, gap: float = 0.20) -> DataFrame:
    """Thirteen rates and means of structured answers (column `answer`, with reference and source) for each key.

    The true score is the bounded quality of the translation read from the answer. A stated score `gap` or more above it is
    false confidence, below it underconfidence; both over the answers that state one. Rates are in per cent, means of
    nothing are 0.
    """
    read = df.withColumn("_a", parsing.structured_answer(F.col(answer))).withColumn("prediction", F.col("_a.translation"))
    s = rewards.with_signals(read)
    a, true = F.col("_a"), F.col("s_quality")
    stated, thought = a["self_score"], F.coalesce(a["thought"], F.lit(""))
    ahead = stated - true
    words = lambda c: F.size(T.metric_tokens(c))
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return s.groupBy(*keys).agg(
        F.count("*").alias("n"),
        _rate(a["has_format"]).alias("format_rate"),
        _rate(a["has_thought_format"] if need_thought else a["has_format"]).alias("required_format_rate"),
        _rate(a["has_thought_format"]).alias("thinking_format_rate"),
        _rate(stated.isNull()).alias("missing_score_rate"),
        zero(stated).alias("avg_self_score"),
        zero(true).alias("avg_true_score"),
        zero(F.abs(ahead)).alias("avg_score_gap"),
        _rate(ahead >= gap).alias("false_confidence_rate"),
        _rate(-ahead >= gap).alias("underconfidence_rate"),
        zero(rewards.thought_score(thought)).alias("avg_thinking_score"),
        zero(F.size(rewards.theme_tags(thought))).alias("avg_thinking_tags"),
        zero(words(a["analysis"])).alias("avg_analysis_words"),
        zero(words(thought)).alias("avg_thinking_words"),
    )


def label_histogram(labels: DataFrame) -> DataFrame:
    """(severity, rationale, n, score): how often each label occurs, unreadable ones as nulls, and its mean score."""
    return labels.groupBy("severity", "rationale").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
