"""Translation metrics, n-gram counts, edit rates and small models against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import edit_rate, overlap
from corpuslab.functions import text as T
from corpuslab.operators import corpus_scores, training

RNG = random.Random(4)
WORDS = ["wasi", "runa", "ñan", "allin,", "a", "!", "(x)", "日本", "3.5", "it's"]
ROWS = [("", ""), ("a", ""), ("", "a b"), ("same text.", "same text."), *((" ".join(RNG.choices(WORDS, k=RNG.randint(1, 12))), " ".join(RNG.choices(WORDS, k=RNG.randint(1, 12)))) for _ in range(60))]


def grams(items, n):
    return Counter(tuple(items[k : k + n]) for k in range(len(items) - n + 1))


def test_shared_ngrams_match_counters(spark):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([*ROWS, (None, "a")])], "k int, a string, b string")
    got = df.select("k", overlap.letter_stats("a", "b").alias("s"), overlap.item_stats(F.split("a", " "), F.split("b", " ")).alias("w")).collect()
    for r in got:
        a, b = [*ROWS, ("", "a")][r["k"]]
        want = [v for n in range(1, 7) for v in (max(0, len(a) - n + 1), max(0, len(b) - n + 1), sum((grams(a, n) & grams(b, n)).values()))]
        assert r["s"] == want
        if r["k"] < len(ROWS):
            x, y = a.split(" "), b.split(" ")
            assert r["w"][2::3] == [sum((grams(x, n) & grams(y, n)).values()) for n in range(1, 5)]


def test_punctuation_splits_off(spark):
    got = spark.createDataFrame([("Hola, (mundo) a. ! ...",)], "t string").select(overlap.split_words(F.col("t"))).first()[0]
    assert got == ["Hola", ",", "(mundo", ")", "a", ".", "!", "..", "."]


def brute_edits(hyp, ref):
    cost = list(range(len(ref) + 1))
    for i, w in enumerate(hyp, 1):
        cost, before = [i], cost
        for j, v in enumerate(ref, 1):
            cost.append(min(before[j - 1] + (w != v), before[j] + 1, cost[-1] + 1))
    return cost[-1]


def test_edit_distance_and_shifts():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 8))] for _ in range(2))
        plain, steps = edit_rate.distance(a, b)
        assert plain == brute_edits(a, b)
        assert edit_rate.edits(a, b) <= plain or not b
        if a and b:
            numbers = np.array([[ord(c) for c in a]])
            assert edit_rate.distances(numbers, np.array([ord(c) for c in b]))[0] == plain
    assert edit_rate.edits("b c d e a".split(), "a b c d e".split()) == 1  # one shift
    assert edit_rate.edits("x y a b c".split(), "a b c x y".split()) == 1
    assert edit_rate.edits("a b".split(), []) == 2 and edit_rate.edits([], "a b".split()) == 2


def test_corpus_scores_come_from_summed_statistics(spark):
    df = spark.createDataFrame([(1, a, b, "x") for a, b in ROWS], "part int, prediction string, reference string, source string")
    got = corpus_scores.corpus_scores(df, ["part"]).first()
    h, r, m = (np.zeros(6) for _ in range(3))
    edits = words = 0
    for a, b in ROWS:
        x, y = ("".join(t.split()) for t in (a, b))
        for n in range(1, 7):
            h[n - 1] += max(0, len(x) - n + 1)
            r[n - 1] += max(0, len(y) - n + 1)
            m[n - 1] += sum((grams(x, n) & grams(y, n)).values())
        edits += edit_rate.edits(a.lower().split(), b.lower().split())
        words += len(b.split())
    p, q = (m / h).mean(), (m / r).mean()
    assert got["n"] == len(ROWS) and got["chrf_letters"] == pytest.approx(100 * 5 * p * q / (4 * p + q))
    assert got["ter"] == pytest.approx(100 * edits / words)


def test_text_keys(spark):
    df = spark.createDataFrame([("Ñandú élan Ça e\u0301", "Uno uno DOS a tres uno")], "t string, p string")
    got = df.select(T.without_accents(F.col("t")).alias("t"), T.prompt_tokens(F.col("p")).alias("p"), T.composed(F.col("t")).alias("c")).first()
    assert got["t"] == "Nandu elan Ca e" and got["p"] == ["Uno", "DOS", "tres"] and got["c"].endswith("é")


def groups(n=60, k=5, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        for _ in range(k):
            good, noise = rng.normal(), rng.normal()
            rows.append((g, good, noise, good * 2 + 0.1 * rng.normal()))
    return pd.DataFrame(rows, columns=["g", "pairwise_chrf", "repetition", "truth"])


def test_trained_models_find_the_telling_feature():
    rows = groups()
    names = ["pairwise_chrf", "repetition"]
    starts = np.flatnonzero(np.append(True, np.diff(rows["g"]) != 0))
    oracle = float(np.mean([c["truth"].max() for _, c in rows.groupby("g")]))
    for fit in (lambda: training.hill_climb(rows, "g", names, "truth"), lambda: training.listwise(rows, "g", names, "truth")):
        model = fit()
        x, _, _ = training.standardised(rows, names)
        scores = x @ np.array([model.weights[n] for n in names])
        assert training.chosen_mean(scores, rows["truth"].to_numpy(), starts) > 0.95 * oracle
        assert training.Model.from_json(model.to_json()) == model
        assert fit() == model
    assert training.hill_climb(rows, "g", names, "truth", clamp=True).weights["repetition"] <= 0


def test_stumps_lower_the_error_and_clamps_keep_signs():
    rows = groups()
    model = training.boosted_stumps(rows, ["pairwise_chrf", "repetition"], "truth", rounds=40, rate=0.3)
    x, _, _ = training.standardised(rows, ["pairwise_chrf", "repetition"])
    y = rows["truth"].to_numpy()
    column = {"pairwise_chrf": 0, "repetition": 1}
    fitted = model.bias + sum(np.where(x[:, column[s["feature"]]] <= s["threshold"], s["left"], s["right"]) for s in model.stumps)
    assert ((y - fitted) ** 2).mean() < 0.15 * y.var()
    assert training.clamped({"repetition": 0.4, "pairwise_chrf": -1.0, "other": -2.0}) == {"repetition": 0.0, "pairwise_chrf": 0.0, "other": -2.0}


def test_sparse_pairs_are_ranked():
    rows = [(g, {1: 1.0, 2: float(k)}, float(-k)) for g, k in itertools.product(range(20), range(3))]
    weights = training.pairwise_sparse(rows, 8)
    assert weights[2] < -0.5 and abs(weights[1]) < 1e-9 and not weights[3:].any()


def test_edit_distances_keep_their_steps():
    """Against the recurrence in plain Python: the distance, and keep or change before drop before add."""
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        cost = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        found, steps = edit_rate.distance(a, b)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                across, drop = cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1
                cost[i, j] = min(across, drop, cost[i, j - 1] + 1)
                step = (edit_rate.KEEP if a[i - 1] == b[j - 1] else edit_rate.CHANGE) if cost[i, j] == across else edit_rate.DROP if cost[i, j] == drop else edit_rate.ADD
                assert steps[i, j] == step
        assert found == cost[len(a), len(b)]
    many = np.zeros((2, 20_000), np.int64)  # more words than 16 bits count
    assert edit_rate.distances(many, np.zeros(1, np.int64)).tolist() == [19_999, 19_999]
