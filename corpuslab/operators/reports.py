"""Aggregates, gates and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gate(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """df with reasons (the names of failed checks, in order; a null check fails) and passed."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)))
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def exclusive_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles at rank share * (n + 1) among the sorted values, linear in between and flat beyond the ends."""
    w = W.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    outs = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") + 1)
        low = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(F.col("_n") - 1, F.lit(1)))
        part = at - low
        weight = F.when(F.col("_n") == 1, F.when(F.col("_r") == 1, 1.0).otherwise(0.0)).when(F.col("_r") == low, 1 - part).when(F.col("_r") == low + 1, part).otherwise(0.0)
        outs.append(F.sum(F.col("_v") * weight).alias(name))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), *outs)


def population_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std): the population deviation, 1 where it vanishes."""
    aggs = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.when(F.coalesce(F.stddev_pop(c), F.lit(0.0)) <= 1e-9, 1.0).otherwise(F.stddev_pop(c)).alias("std")) for c in columns]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def relative_scores(df: DataFrame, keys: list, score: str) -> DataFrame:
    """(score - least) / max(1e-6, most - least) of the group; a lone score as it is."""
    w = W.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("relative", F.when(F.count("*").over(w) == 1, F.col(score).cast("double")).otherwise((F.col(score) - low) / F.greatest(F.lit(1e-6), high - low)))


def extremes(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Best and worst label of each group (of equal scores the least label) and their distance."""
    w = W.partitionBy(*keys)
    ranked = df.withColumns({"_b": F.row_number().over(w.orderBy(F.desc(score), label)), "_w": F.row_number().over(w.orderBy(score, label))})
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("_b") == 1, F.col(label))).alias("best"), F.max(F.when(F.col("_w") == 1, F.col(label))).alias("worst"), (F.max(score) - F.min(score)).alias("gap"))


def most_common(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; of equal counts the least value first."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def leaderboard(df: DataFrame, order: list) -> DataFrame:
    """df with place by the given order, which must break ties. The board is small: a row for each run."""
    return df.withColumn("place", F.row_number().over(W.orderBy(*order)))


def selection_score(chrf, bleu, f1, length, copied, exact, leak, artifacts, ter) -> Column:
    """One number from external metrics; a missing error rate counts as 100."""
    return 0.45 * chrf + 0.15 * bleu + 0.25 * f1 + 0.05 * length - 0.30 * copied - 0.40 * exact - 0.25 * leak - 0.35 * artifacts - 0.03 * F.coalesce(ter, F.lit(100.0))


def size_stats(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """(keys, least_chars, mean_chars, most_chars, n) of a length."""
    return df.groupBy(*keys).agg(F.min(size).alias("least_chars"), F.round(F.avg(size), 4).alias("mean_chars"), F.max(size).alias("most_chars"), F.count("*").alias("n"))
