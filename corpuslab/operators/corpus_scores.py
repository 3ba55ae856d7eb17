"""Scores of a whole set of predictions: n-gram and edit scores from summed statistics, the others as means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edit_rate, overlap
from ..functions import metrics as M
from ..functions import text as T


def corpus_scores(df: DataFrame, keys: list[str], edit_rates: bool = True) -> DataFrame:
    """A row for each key of df (prediction, reference, source): the scores in per cent and mean word counts.

    Character F-score, n-gram precision and edit rate come from statistics summed over the rows, not from the mean of
    sentence scores; a task sends some forty numbers a key. A null source copies nothing.
    """
    h, r, s = (F.coalesce(F.col(c), F.lit("")) for c in ("prediction", "reference", "source"))
    rows = df.withColumns({"_h": T.metric_tokens(h), "_r": T.metric_tokens(r), "_s": T.metric_tokens(s), "_chrf": overlap.chrf_stats(h, r), "_bleu": overlap.bleu_stats(h, r)})
    sums = [*overlap.sums("_chrf", 24), *overlap.sums("_bleu", 12)]
    if edit_rates:
        rows = rows.withColumn("_ter", edit_rate.ter_stats(h, r))
        sums += overlap.sums("_ter", 2)
    means = {
        "token_f1": 100 * M.token_f1(F.col("_h"), F.col("_r")),
        "length_ratio": 100 * M.length_ratio_score(h, r),
        "leak": 100 * M.leakage_penalty(F.col("_h")),
        "artifacts": 100 * M.artifact_penalty(h),
        "exact_copy_rate": 100 * M.exact_copy(h, s).cast("int"),
        "copied": 100 * M.source_copy_ratio(F.col("_h"), F.col("_s")),
        "prediction_words": M.n_words(h),
        "reference_words": M.n_words(r),
    }
    rows = rows.select(*keys, *(c for c in ("_chrf", "_bleu", *(["_ter"] if edit_rates else []))), *(v.alias(k) for k, v in means.items()))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *(F.avg(k).alias(k) for k in means))
    scores = {"chrf": 100 * overlap.chrf_of(F.col("_c")), "chrf_letters": 100 * overlap.chrf_of(F.col("_c"), words=False), "bleu": 100 * overlap.bleu_of(F.col("_b"))}
    found = found.withColumns({"_c": overlap.gathered("_chrf", 24), "_b": overlap.gathered("_bleu", 12)})
    if edit_rates:
        found = found.withColumn("_t", overlap.gathered("_ter", 2))
        scores["ter"] = 100 * edit_rate.ter_of(F.col("_t"))
    return found.select(*keys, "n", *(v.alias(k) for k, v in scores.items()), *means)


def selection_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of chosen candidates: how many aren't the first of their group, in per cent, and their mean index."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (100 * F.avg((F.col("candidate_index") != 0).cast("int"))).alias("non_first_rate"), F.avg("candidate_index").alias("mean_index"))
