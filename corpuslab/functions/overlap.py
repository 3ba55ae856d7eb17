"""Column functions that count n-grams two texts share: one Arrow batch at a time, by sorting hashes, without a loop over rows.

Built-in functions would need a scan of one array for each item of the other, and a join would shuffle every n-gram.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .fixed import PUNCTUATION
from .text import normalize_space

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
CHARS, WORDS = 6, 2
MOST_SYMBOLS = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _letters(a: pd.Series, b: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side the code points of all rows and each row's offset in them; a null has none."""
    sides = []
    for s in (a.fillna(""), b.fillna("")):
        codes = np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
        sides.append((codes, np.concatenate(([0], np.cumsum(s.str.len().to_numpy(np.int64))))))
    return sides


def _items(a: pd.Series, b: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for arrays of strings, which get numbers in place of code points."""
    rows = [[x if x is not None else () for x in s] for s in (a, b)]
    sizes = [np.array([len(x) for x in r], np.int64) for r in rows]
    every = [w for r in rows for x in r for w in x]
    codes = pd.factorize(np.array(every, object), use_na_sentinel=False)[0].astype(_U) if every else np.zeros(0, _U)
    cut = int(sizes[0].sum())
    return [(c, np.concatenate(([0], np.cumsum(n)))) for c, n in zip((codes[:cut], codes[cut:]), sizes, strict=True)]


def shared(sides: list[tuple[np.ndarray, np.ndarray]], orders: int) -> np.ndarray:
    """(rows, orders, 3): windows of 1 to `orders` symbols on either side and how many they share, with multiplicities.
    As many rows as hold MOST_SYMBOLS are taken at once, one at least."""
    ends = sides[0][1] + sides[1][1]
    cuts = [0]
    while cuts[-1] < len(ends) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + MOST_SYMBOLS, "right")) - 1))
    parts = [_shared([(codes[of[a] : of[b]], of[a : b + 1] - of[a]) for codes, of in sides], orders) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate(parts) if parts else np.zeros((0, orders, 3), np.int32)


def _shared(sides: list[tuple[np.ndarray, np.ndarray]], orders: int) -> np.ndarray:
    rows = len(sides[0][1]) - 1
    out = np.zeros((rows, orders, 3), np.int32)
    owner = [np.repeat(np.arange(rows), np.diff(of)) for _, of in sides]
    mixed = [_mix(codes + _BASE) for codes, _ in sides]
    hashes = [np.zeros(len(m), _U) for m in mixed]
    for n in range(1, orders + 1):
        keys, docs = [], []
        for side, (_, of) in enumerate(sides):
            h = hashes[side] * _BASE
            h[: max(0, len(h) - n + 1)] += mixed[side][n - 1 :]
            hashes[side] = h
            inside = np.arange(len(h)) + n <= of[1:][owner[side]]
            doc = owner[side][inside]
            keys.append(_mix(h[inside]) + _mix(doc.astype(_U)))
            docs.append(doc)
            out[:, n - 1, side] = np.bincount(doc, minlength=rows)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        if not len(distinct):
            continue
        cut = len(keys[0])
        both = np.minimum(np.bincount(place[:cut], minlength=len(distinct)), np.bincount(place[cut:], minlength=len(distinct)))
        of_key = np.zeros(len(distinct), np.int64)
        of_key[place] = np.concatenate(docs)
        out[:, n - 1, 2] = np.bincount(of_key, both, minlength=rows)
    return out


def _lists(stats: np.ndarray) -> pd.Series:
    return pd.Series(list(stats.reshape(len(stats), -1)), dtype=object)


@F.pandas_udf(IntegerType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many items two arrays share, with multiplicities; a null array shares none."""
    return pd.Series(shared(_items(a, b), 1)[:, 0, 2])


@F.pandas_udf(ArrayType(IntegerType()))
def letter_stats(a: pd.Series, b: pd.Series) -> pd.Series:
    """For n = 1 to 6: n-grams of characters of a, of b, and how many they share."""
    return _lists(shared(_letters(a, b), CHARS))


@F.pandas_udf(ArrayType(IntegerType()))
def pair_stats(a: pd.Series, b: pd.Series) -> pd.Series:
    """For n = 1 and 2: n-grams of items of a, of b, and how many they share."""
    return _lists(shared(_items(a, b), WORDS))


@F.pandas_udf(ArrayType(IntegerType()))
def item_stats(a: pd.Series, b: pd.Series) -> pd.Series:
    """For n = 1 to 4: n-grams of items of a, of b, and how many they share."""
    return _lists(shared(_items(a, b), 4))


def sums(stats: str, size: int) -> list[Column]:
    """Aggregates that add up statistics element by element."""
    return [F.sum(F.get(F.col(stats), F.lit(k)).cast("long")).alias(f"{stats}_{k}") for k in range(size)]


def gathered(stats: str, size: int) -> Column:
    """What sums() gave, as one array."""
    return F.array(*(F.coalesce(F.col(f"{stats}_{k}"), F.lit(0).cast("long")) for k in range(size)))


def without_space(text: Column) -> Column:
    return F.replace(normalize_space(text), F.lit(" "), F.lit(""))


def split_words(text: Column) -> Column:
    """Words between white space, a punctuation mark at a word's end, else at its start, standing alone."""
    norm = normalize_space(text)
    marks = F.lit(PUNCTUATION)

    def parts(w: Column) -> Column:
        n = F.char_length(w)
        first, last = F.left(w, F.lit(1)), F.right(w, F.lit(1))
        return F.when(n == 1, F.array(w)).when(F.contains(marks, last), F.array(F.left(w, n - 1), last)).when(F.contains(marks, first), F.array(first, F.right(w, n - 1))).otherwise(F.array(w))

    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.split(norm, " "), parts)))


def _f2(stats: Column, orders: int) -> Column:
    """F2 of mean precision and mean recall over the orders that both sides have; from 0 to 1."""

    def at(k: int) -> Column:
        return F.get(stats, F.lit(k))

    known = [(at(3 * n) > 0) & (at(3 * n + 1) > 0) for n in range(orders)]
    count = reduce(lambda a, b: a + b, [k.cast("int") for k in known])
    precision, recall = (reduce(lambda a, b: a + b, [F.when(k, at(3 * n + 2) / at(3 * n + side)).otherwise(0.0) for n, k in enumerate(known)]) / F.greatest(count, F.lit(1)) for side in (0, 1))
    return F.when(precision + recall > 0, 5.0 * precision * recall / (4.0 * precision + recall)).otherwise(0.0)


def chrf_stats(hyp: Column, ref: Column, words: bool = True) -> Column:
    """Statistics of the character F-score, with word orders unless `words` is false. They add up over rows."""
    letters = letter_stats(without_space(hyp), without_space(ref))
    return F.concat(letters, pair_stats(split_words(hyp), split_words(ref))) if words else letters


def chrf_of(stats: Column, words: bool = True) -> Column:
    """The score, from 0 to 1, of one row's statistics or of the sums over many."""
    return _f2(stats, CHARS + WORDS if words else CHARS)


def evaluation_tokens(text: Column) -> Column:
    """Tokens of the usual evaluation script: marks stand alone, but not points and commas between digits."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<skipped>|-\n", "")
    t = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), [("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")], t)
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\x20-\x26\x28-\x2B\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([.,])([^0-9])", " $1 $2")
    t = normalize_space(F.regexp_replace(t, r"([0-9])(-)", "$1 $2 "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def bleu_stats(hyp: Column, ref: Column) -> Column:
    """Statistics of n-gram precision for n = 1 to 4; the counts of n = 1 are the lengths. They add up over rows."""
    return item_stats(evaluation_tokens(hyp), evaluation_tokens(ref))


def bleu_of(stats: Column) -> Column:
    """From 0 to 1: geometric mean of the precisions up to the last order that the hypothesis has, times the brevity
    penalty. The k-th order without a match counts as 1 / 2**k of a match; no match at all is 0."""

    def at(k: int) -> Column:
        return F.get(stats, F.lit(k))

    total, match = [at(3 * n) for n in range(4)], [at(3 * n + 2) for n in range(4)]
    alive = [reduce(lambda a, b: a & b, [total[k] > 0 for k in range(n + 1)]) for n in range(4)]
    misses = [reduce(lambda a, b: a + b, [(match[k] == 0).cast("int") for k in range(n + 1)]) for n in range(4)]
    logs = [F.when(alive[n], F.when(match[n] > 0, F.log(match[n] / total[n])).otherwise(-F.log(F.pow(F.lit(2.0), misses[n]) * total[n]))).otherwise(0.0) for n in range(4)]
    orders = reduce(lambda a, b: a + b, [a.cast("int") for a in alive])
    short = F.when(at(0) < at(1), F.exp(1.0 - at(1) / at(0))).otherwise(1.0)
    some = reduce(lambda a, b: a | b, [m > 0 for m in match])
    return F.when((at(0) > 0) & some, short * F.exp(reduce(lambda a, b: a + b, logs) / orders)).otherwise(0.0)
