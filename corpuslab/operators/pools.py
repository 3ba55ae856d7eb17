"""Candidate pools: indices, consensus, choice and the pairs made from them.

A pool has group, candidate_index, prediction, source and reference; everything about a group is computed in one
partitioning by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import agreement, overlap
from ..functions import metrics as M
from ..functions import text as T


def indexed(df: DataFrame, keys: list, order: list) -> DataFrame:
    """candidate_index: order of arrival within the key, from 0."""
    return df.withColumn("candidate_index", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def merged(pools: list[DataFrame], keys: list[str]) -> DataFrame:
    """The pools one after the other, without predictions that equal an earlier one of their group, with new indices."""
    parts = [p.withColumn("pool", F.lit(k)) for k, p in enumerate(pools)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    same = F.lower(T.normalize_space(F.col("prediction")))
    first = union.withColumn("_n", F.row_number().over(W.partitionBy(*keys, same).orderBy("pool", "candidate_index"))).filter("_n = 1").drop("_n")
    return indexed(first.withColumnRenamed("candidate_index", "old_index"), keys, ["pool", "old_index"]).drop("old_index")


def best(df: DataFrame, keys: list, score: str) -> DataFrame:
    """The row of each group with the highest score; of equal ones that with the lowest index."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), "candidate_index"))).filter("_n = 1").drop("_n")


def with_margin(df: DataFrame, keys: list, score: str) -> DataFrame:
    """The best row of each group, its lead over the second (0 if it is alone) and the group's size."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), "candidate_index")
    ranked = df.withColumns({"_n": F.row_number().over(w), "_next": F.lead(score).over(w), "candidate_count": F.count("*").over(W.partitionBy(*keys))})
    return ranked.filter("_n = 1").withColumn("margin", F.greatest(F.lit(0.0), F.coalesce(F.col(score) - F.col("_next"), F.lit(0.0)))).drop("_n", "_next")


def zscored(df: DataFrame, keys: list, columns: list[str]) -> DataFrame:
    """Each column less its group's mean, over the group's population deviation (1 where that vanishes)."""
    w = W.partitionBy(*keys)

    def z(c: str) -> Column:
        spread = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(spread <= 1e-9, 1.0).otherwise(spread)

    return df.withColumns({f"{c}_z": z(c) for c in columns})


def signals(df: DataFrame) -> DataFrame:
    """The signals of a candidate that need its source only; tokens are made once."""
    df = df.withColumns({"tokens": T.metric_tokens(F.col("prediction")), "source_tokens": T.metric_tokens(F.col("source"))})
    return df.withColumns(
        {
            "copied": M.source_copy_ratio(F.col("tokens"), F.col("source_tokens")),
            "leak": M.leakage_penalty(F.col("tokens")),
            "artifacts": M.artifact_penalty(F.col("prediction")),
            "repeated": M.repetition_penalty(F.col("tokens")),
            "exact": M.exact_copy(F.col("prediction"), F.col("source")),
            "n_tokens": F.size("tokens"),
        }
    )


def length_consensus(df: DataFrame, keys: list) -> DataFrame:
    """How near each candidate's token count is to its group's median."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    middle = F.percentile(n, F.lit(0.5)).over(W.partitionBy(*keys))
    return df.withColumn("length_consensus", F.greatest(F.lit(0.0), 1.0 - F.abs(F.log(n / F.greatest(middle, F.lit(1.0))))))


def with_utilities(df: DataFrame, keys: list[str], most: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (of its columns `keep`, if given) with utility, peers, and the means chrf, f1 and precision: how well a candidate
    agrees with its peers, 0.55 of the character F-score, 0.30 of token F1 and 0.15 of token precision.

    Peers are the candidates with another prediction, or all if there is none; `most` takes that many of them evenly
    spaced. Equal predictions have equal tokens. A group is handled by one task, without a row for each pair. All columns
    that are kept pass through Python, and the plan can't leave any out by itself.
    """
    parts = ("_letters", "_words", "tokens")
    keep = keep or df.columns
    rows = df.withColumns({"_letters": overlap.without_space(F.col("prediction")), "_words": overlap.split_words(F.col("prediction"))})
    # the window brings a group's rows together in order, without a shuffle if they are already; unless its column goes along, the plan drops it
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("candidate_index")))
    rows = rows.select(*dict.fromkeys([*keys, "prediction", *parts, *keep, "_place"]))
    kept = {f.name: f for f in rows.schema}
    schema = StructType([kept[c] for c in keep] + [StructField(c, LongType() if c == "peers" else DoubleType()) for c in agreement.COLUMNS])
    found = rows.mapInArrow(lambda batches: agreement.agreed(batches, keys, "prediction", parts, most, keep), schema)
    return found.withColumn("utility", 0.55 * F.col("chrf") + 0.30 * F.col("f1") + 0.15 * F.col("precision"))


def peer_utilities(df: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, candidate_index, utility, peers, chrf, f1, precision) of with_utilities()."""
    return with_utilities(df.select(*keys, "candidate_index", "prediction", "tokens"), keys, most, [*keys, "candidate_index"])


def preferences(df: DataFrame, keys: list, score: str, least_margin: float, strategy: str = "hard") -> DataFrame:
    """The best candidate of each group against another: the next best (hard), the worst, or the first one."""
    w = W.partitionBy(*keys)
    down = w.orderBy(F.desc(score), "candidate_index")
    order = {"hard": down, "worst": w.orderBy(score, "candidate_index"), "first": w.orderBy("candidate_index")}[strategy]
    ranked = df.withColumns({"_best": F.row_number().over(down), "chosen_index": F.first("candidate_index").over(down), "chosen_score": F.first(score).over(down), "candidate_count": F.count("*").over(w)})
    losers = ranked.filter("_best > 1").withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    out = losers.select(*keys, "chosen_index", "chosen_score", F.col("candidate_index").alias("rejected_index"), F.col(score).alias("rejected_score"), "candidate_count")
    return out.withColumn("score_margin", F.col("chosen_score") - F.col("rejected_score")).filter(F.col("score_margin") >= least_margin)


def votes(df: DataFrame, key: str, answer: str, rank: str) -> DataFrame:
    """The answer of each key with most votes, of equal ones that with the best rank, then the least; how far the voters agree."""
    tally = df.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(rank).alias("_rank"))
    w = W.partitionBy(key)
    picked = tally.withColumns({"n_votes": F.sum("n").over(w), "n_answers": F.count("*").over(w), "_place": F.row_number().over(w.orderBy(F.desc("n"), "_rank", answer))}).filter("_place = 1")
    agreement = F.when(F.col("n_votes") == 1, "single").when(F.col("n") >= 2, F.concat(F.col("n").cast("string"), F.lit("-way"))).otherwise("disagree")
    return picked.select(key, F.col(answer).alias("winner"), F.col("n").alias("top_count"), "n_votes", "n_answers", agreement.alias("agreement"))


def softmax(df: DataFrame, keys: list, score: str, temperature: float = 1.0) -> DataFrame:
    """Soft targets of a group: exponents limited to 60 either way, the temperature floored."""
    w = W.partitionBy(*keys)
    e = F.exp(F.least(F.lit(60.0), F.greatest(F.lit(-60.0), (F.col(score) - F.max(score).over(w)) / F.lit(max(temperature, 1e-6)))))
    return df.withColumn("_e", e).withColumn("soft", F.col("_e") / F.sum("_e").over(w)).drop("_e")
