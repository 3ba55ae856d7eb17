"""Small models of candidates, fitted on the driver from a bounded number of groups and applied as data (scoring.py).

The features of at most `most` groups, chosen by a hash of their key, come to the driver; scoring covers all rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# signals whose weights can't be positive, and those whose weights can't be negative
PENALTIES = ("source_copy_ratio", "spanish_leakage", "chat_artifact", "repetition", "exact_source_copy", "candidate_index_fraction")
AGREEMENTS = ("pairwise_chrf", "pairwise_bleu", "pairwise_token_f1", "pairwise_precision", "pairwise_jaccard", "length_consensus", "duplicate_rate")


@dataclass
class Model:
    """Weights and stumps over standardised features."""

    names: list[str]
    means: dict[str, float]
    stds: dict[str, float]
    weights: dict[str, float]
    bias: float = 0.0
    stumps: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Model:
        return Model(**json.loads(text))


def sampled(df: DataFrame, key: str, columns: list[str], most: int = 5_000) -> pd.DataFrame:
    """key and columns of at most about `most` groups, sorted; whole groups stay together."""
    n = df.select(key).distinct().count()
    part = df if n <= most else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) < most)
    return part.select(key, *columns).toPandas().sort_values([key, *columns], kind="stable").reset_index(drop=True)


def standardised(rows: pd.DataFrame, names: list[str]) -> tuple[np.ndarray, dict[str, float], dict[str, float]]:
    """(values less their mean over the population deviation, 1 where that vanishes; means; deviations)."""
    x = rows[names].to_numpy(float)
    mean = x.mean(axis=0) if len(x) else np.zeros(len(names))
    std = x.std(axis=0) if len(x) > 1 else np.ones(len(names))
    std = np.where(std > 1e-9, std, 1.0)
    return (x - mean) / std, dict(zip(names, mean.tolist(), strict=True)), dict(zip(names, std.tolist(), strict=True))


def clamped(weights: dict[str, float]) -> dict[str, float]:
    """Weights of penalties no higher, of agreements no lower than 0."""
    limit = lambda k, v: min(0.0, v) if k in PENALTIES else max(0.0, v) if k in AGREEMENTS else v
    return {k: limit(k, v) for k, v in weights.items()}


def _starts(groups: pd.Series) -> np.ndarray:
    return np.flatnonzero(np.append(True, groups.to_numpy()[1:] != groups.to_numpy()[:-1])) if len(groups) else np.zeros(0, np.int64)


def chosen_mean(scores: np.ndarray, truth: np.ndarray, starts: np.ndarray) -> float:
    """The mean truth of each group's best score, of equal ones the first."""
    if not len(starts):
        return 0.0
    best = np.maximum.reduceat(scores, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(scores))))
    hit = np.flatnonzero(scores == best[group])
    first = hit[np.append(True, group[hit][1:] != group[hit][:-1])]
    return float(truth[first].mean())


def hill_climb(rows: pd.DataFrame, key: str, names: list[str], truth: str, steps: int = 400, seed: int = 7, clamp: bool = False) -> Model:
    """Random changes of one weight, kept if the chosen candidates' mean truth grows."""
    x, means, stds = standardised(rows, names)
    y, starts, rng = rows[truth].to_numpy(float), _starts(rows[key]), np.random.default_rng(seed)
    weights = np.zeros(len(names))
    best = chosen_mean(x @ weights, y, starts)
    for step in range(steps):
        trial = weights.copy()
        trial[rng.integers(len(names))] += rng.normal(0, 1.0 if step < steps // 2 else 0.25)
        if clamp:
            trial = np.array(list(clamped(dict(zip(names, trial.tolist(), strict=True))).values()))
        value = chosen_mean(x @ trial, y, starts)
        if value > best:
            weights, best = trial, value
    return Model(names, means, stds, dict(zip(names, weights.tolist(), strict=True)))


def listwise(rows: pd.DataFrame, key: str, names: list[str], truth: str, epochs: int = 60, rate: float = 0.05, temperature: float = 0.1, ridge: float = 1e-3) -> Model:
    """Weights whose softmax in each group comes near the softmax of the truth over `temperature`."""
    x, means, stds = standardised(rows, names)
    starts = _starts(rows[key])
    weights = np.zeros(len(names))
    if len(starts):
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))

        def soft(v: np.ndarray) -> np.ndarray:
            e = np.exp(np.clip(v - np.maximum.reduceat(v, starts)[group], -60, 60))
            return e / np.add.reduceat(e, starts)[group]

        wanted = soft(rows[truth].to_numpy(float) / max(temperature, 1e-6))
        for _ in range(epochs):
            weights -= rate * (x.T @ (soft(x @ weights) - wanted) / len(starts) + ridge * weights) * len(names)
    return Model(names, means, stds, dict(zip(names, weights.tolist(), strict=True)))


def boosted_stumps(rows: pd.DataFrame, names: list[str], truth: str, base: Model | None = None, rounds: int = 30, rate: float = 0.1, least: int = 5, cuts: int = 16) -> Model:
    """Stumps that fit what base (or the mean) leaves of the truth: each asks one standardised feature at one of its quantiles, with `least` rows on either side."""
    x, means, stds = standardised(rows, names)
    y = rows[truth].to_numpy(float)
    start = x @ np.array([base.weights.get(n, 0.0) for n in names]) + base.bias if base else np.full(len(y), y.mean() if len(y) else 0.0)
    model = Model(names, means, stds, dict(base.weights) if base else {n: 0.0 for n in names}, base.bias if base else float(y.mean() if len(y) else 0.0))
    left_over = y - start
    for _ in range(rounds):
        best = None
        for k, name in enumerate(names):
            for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, cuts + 2)[1:-1])) if len(x) else ():
                low = x[:, k] <= cut
                n = int(low.sum())
                if n < least or len(x) - n < least:
                    continue
                a, b = left_over[low].mean(), left_over[~low].mean()
                gain = n * a * a + (len(x) - n) * b * b
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, k, name, float(cut), a, b, low)
        if best is None or best[0] <= 1e-12:
            break
        _, _, name, cut, a, b, low = best
        model.stumps.append({"feature": name, "threshold": cut, "left": rate * float(a), "right": rate * float(b)})
        left_over = left_over - np.where(low, rate * a, rate * b)
    return model


def pairwise_sparse(rows: list[tuple[object, dict[int, float], float]], size: int, epochs: int = 5, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> np.ndarray:
    """Weights of hashed features from (group, features, truth): logistic steps on pairs of a group's best and each other row, in a seeded order."""
    groups: dict[object, list[tuple[dict[int, float], float]]] = {}
    for group, features, truth in rows:
        groups.setdefault(group, []).append((features, truth))
    pairs = [(best[0], other[0]) for g in groups.values() for best in [max(g, key=lambda r: r[1])] for other in g if other[1] < best[1]]
    weights, rng = np.zeros(size), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(pairs)):
            good, bad = pairs[k]
            difference = {i: good.get(i, 0.0) - bad.get(i, 0.0) for i in good.keys() | bad.keys()}
            at = np.fromiter(difference, np.int64, len(difference))
            value = np.fromiter(difference.values(), float, len(difference))
            push = 1.0 / (1.0 + np.exp(np.clip(weights[at] @ value, -60, 60)))
            weights[at] += rate * (push * value - ridge * weights[at])
    return weights
