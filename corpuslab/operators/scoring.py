"""Models as data: linear weights with stumps over feature columns, and hashed sparse features with a dot product."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_score(model: dict) -> Column:
    """bias + sum weight * (x - mean) / std + a value from each stump, which asks whether its feature is at most a threshold."""

    def z(name: str) -> Column:
        return (F.col(name) - model["means"][name]) / model["stds"][name]

    parts = [F.lit(float(model.get("bias", 0.0))), *(z(n) * float(w) for n, w in model["weights"].items())]
    parts += [F.when(z(s["feature"]) <= s["threshold"], float(s["left"])).otherwise(float(s["right"])) for s in model.get("stumps", [])]
    return reduce(lambda a, b: a + b, parts)


def sparse_features(df: DataFrame, keys: list[str], named: dict[str, tuple[Column, float]], size: int = 1 << 20) -> DataFrame:
    """(keys, index, value): each item of each named array adds its weight to the index crc32("name:item") mod size."""

    def weighted(name: str, items: Column, weight: float) -> Column:
        return F.transform(items, lambda x: F.struct(F.concat(F.lit(f"{name}:"), x).alias("k"), F.lit(weight).alias("w")))

    arrays = [weighted(name, items, weight) for name, (items, weight) in named.items()]
    flat = df.select(*keys, F.explode(F.concat(*arrays)).alias("f"))
    return flat.groupBy(*keys, (F.crc32(F.col("f.k").cast("binary")) % size).alias("index")).agg(F.sum("f.w").alias("value"))


def sparse_scores(features: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(keys, score): the dot product with weights (index, weight); unknown indices weigh 0."""
    joined = features.join(weights, "index", "left")
    return joined.groupBy(*keys).agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("score"))
