"""Translation edit rate: insertions, deletions, substitutions and shifts of whole phrases, over the reference's length.

The search for shifts is greedy and sequential, so a text is one call; texts come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .text import normalize_space

MOST_SHIFT, FARTHEST, MOST_TRIED = 10, 50, 1000
KEEP, CHANGE, DROP, ADD = range(4)


def distance(hyp: list[str], ref: list[str]) -> tuple[int, np.ndarray]:
    """The word edit distance and, for each pair of prefixes, the last step of a cheapest way: keeping or changing goes
    before dropping a word of hyp, that before adding one of ref."""
    n, m = len(hyp), len(ref)
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], np.int64) for x in (hyp, ref))
    same = a[:, None] == b
    cost = np.zeros((n + 1, m + 1), np.int64)  # less the words of ref so far, which makes adding one free
    for i in range(n):
        best = cost[i] + 1
        np.minimum(best[1:], cost[i, :-1] - same[i], out=best[1:])
        np.minimum.accumulate(best, out=cost[i + 1])
    steps = np.full((n + 1, m + 1), ADD, np.int8)
    steps[1:][cost[1:] == cost[:-1] + 1] = DROP
    across = cost[1:, 1:] == cost[:-1, :-1] - same
    steps[1:, 1:][across] = np.where(same, KEEP, CHANGE)[across]
    return int(cost[n, m]) + m, steps


def alignment(steps: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """(place in hyp for each word of ref, whether each word of hyp is wrong, and each of ref)."""
    i, j = steps.shape[0] - 1, steps.shape[1] - 1
    own, wrong_hyp, wrong_ref = {}, np.zeros(i, bool), np.zeros(j, bool)
    while i or j:
        step = steps[i, j]
        if step == DROP:
            i -= 1
            wrong_hyp[i] = True
        elif step == ADD:
            j -= 1
            wrong_ref[j] = True
            own[j] = i - 1
        else:
            i, j = i - 1, j - 1
            own[j] = i
            wrong_hyp[i] = wrong_ref[j] = step == CHANGE
    return own, wrong_hyp, wrong_ref


def _phrases(hyp: list[str], ref: list[str]) -> Iterator[tuple[int, int, int]]:
    """(start in hyp, start in ref, length) of equal phrases that may move."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        where.setdefault(w, []).append(j)
    for i, w in enumerate(hyp):
        for j in where.get(w, ()):
            if abs(i - j) <= FARTHEST:
                for n in range(1, min(MOST_SHIFT, len(hyp) - i, len(ref) - j) + 1):
                    if hyp[i + n - 1] != ref[j + n - 1]:
                        break
                    yield i, j, n


def _moved(words: list[str], start: int, n: int, to: int) -> list[str]:
    block, rest = words[start : start + n], words[:start] + words[start + n :]
    at = to if to <= start else max(start, to - n)
    return rest[:at] + block + rest[at:]


def distances(options: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """The word edit distance of each row of options (all of one length) and ref, all rows advancing together. Rows lie
    side by side in small numbers, so that each step runs over neighbours in memory."""
    kind = np.int16 if options.shape[1] + len(ref) < 1 << 14 else np.int64
    words, own = np.ascontiguousarray(options.T, np.int32), ref.astype(np.int32)[:, None]
    cost = np.zeros((len(ref) + 1, len(options)), kind)  # less the words of ref so far
    for word in words:
        best = cost + kind(1)
        np.minimum(best[1:], cost[:-1] - (word == own), out=best[1:])
        cost = np.minimum.accumulate(best, axis=0, out=best)
    return cost[-1].astype(np.int64) + len(ref)


def edits(hyp: list[str], ref: list[str]) -> int:
    """Edits and shifts from hyp to ref. The shift that saves most is taken, of equal ones the longest, then the first; until none saves any."""
    if not ref:
        return len(hyp)
    number: dict[str, int] = {}
    ref, hyp = ([number.setdefault(w, len(number)) for w in x] for x in (ref, hyp))  # words are compared as numbers from here
    codes = np.array(ref, np.int64)
    shifts = tried = 0
    before, steps = distance(hyp, ref)
    while before and tried < MOST_TRIED:
        own, wrong_hyp, wrong_ref = alignment(steps)
        options = []
        for i, j, n in _phrases(hyp, ref):
            if not wrong_hyp[i : i + n].any() or not wrong_ref[j : j + n].any() or i <= own[j] < i + n:
                continue
            last = -1
            for k in range(j - 1, j + n):
                to = 0 if k < 0 else own[k] + 1
                if to != last:
                    last = to
                    options.append((n, -i, -to, _moved(hyp, i, n, to)))
                    tried += 1
            if tried >= MOST_TRIED:
                break
        if not options or tried >= MOST_TRIED:
            break
        after = distances(np.array([words for *_, words in options], np.int64), codes)
        best = max((before - int(d), *option) for d, option in zip(after, options, strict=True))
        if best[0] <= 0:
            break
        hyp, shifts = best[4], shifts + 1
        before, steps = distance(hyp, ref)
    return shifts + before


@F.pandas_udf(ArrayType(IntegerType()))
def _stats(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([[edits(a.split(), b.split()), len(b.split())] for a, b in zip(hyp, ref, strict=True)], dtype=object)


def ter_stats(hyp: Column, ref: Column) -> Column:
    """(edits, words of the reference), lower case. They add up over rows."""
    return _stats(F.lower(normalize_space(hyp)), F.lower(normalize_space(ref)))


def ter_of(stats: Column) -> Column:
    """Edits for each word of the reference; 1 if it has none and there are edits."""
    n, m = F.get(stats, F.lit(0)), F.get(stats, F.lit(1))
    return F.when(m > 0, n / F.greatest(m, F.lit(1))).when(n > 0, 1.0).otherwise(0.0)
