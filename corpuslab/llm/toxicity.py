"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors, extreme-value calibration.

A token is a word in lower case; it carries features: the whole word and its first 4, 5 and 6 code points, which tell
inflected and compound forms. From a bounded sample of labelled rows each feature gets the log-odds of standing in a
toxic document against a harmless one, with a Dirichlet prior in proportion to the feature's own frequency, less
`SURE` standard errors. A token scores its best feature if that is positive, and a small negative number otherwise. One
linear scan per text finds every maximal segment. Under the background distribution of token scores the best segment of
n tokens follows an extreme-value law with the rate lambda that solves sum p(s) exp(lambda s) = 1 and the factor K that
the sample's harmless documents make likeliest; a segment's excess is lambda * S - ln(K n). The excesses of a document's significant segments are summed and mapped to [0, 1] by a logistic
curve fitted on the sample's documents with a positive token; the others get the share of toxic labels among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import trimmed, unused
from .labelled import sample
from .textbatch import Hasher, blocks, lower_latin, runs

_U = np.uint64
PREFIXES = (4, 5, 6)
GAP = -0.05
SURE = 2.0
CLEAN = -100.0  # the excess of a text without a positive token
_BITS = 22
_TOKEN = np.zeros(256, bool)
_TOKEN[[0x27, *range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, starts and ends of tokens, offsets of documents in them."""
    data = lower_latin(data)
    starts, ends = runs(_TOKEN[data], offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, hashes): the whole word for every token, then each prefix for the longer ones."""
    of = Hasher(data)
    yield np.arange(len(starts)), of(starts, ends)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    rank = np.searchsorted(leads, starts)
    after = np.append(leads, len(data))
    for k in PREFIXES:
        stop = after[np.minimum(rank + k, len(leads))]
        longer = np.flatnonzero(stop < ends)
        yield longer, of(starts[longer], stop[longer]) ^ _U(k)


@dataclass
class Model:
    """Sorted feature hashes and their scores; the extreme-value rate and ln K; the logistic curve."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    clean: float = 0.0  # the score of a text without a positive token

    def sieve(self) -> np.ndarray:
        bits = np.zeros(1 << _BITS, bool)
        bits[(self.hashes >> _U(64 - _BITS)).astype(np.int64)] = True
        return bits


def segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose tokens outside `at` score `gap`.

    Linear time: a stack of candidates, each with the running total before and after it, is merged from the right.
    """
    found: list[tuple[int, int, float, float]] = []
    total, before = 0.0, -1
    for i, s in zip(at, scores, strict=True):
        total += gap * (i - before - 1)
        first, low, total = i, total, total + s
        before = i
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            first, low = found[k][0], found[k][2]
            del found[k:]
        found.append((first, i, low, total))
    return [(first, last, high - low) for first, last, low, high in found]


def passages(model: Model, sieve: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(document, its tokens, segments with byte ranges inside it and their excess) for the documents with a positive token."""
    data, starts, ends, of = tokens(data, offsets)
    best = np.zeros(len(starts), np.float64)
    if len(model.hashes):
        for rows, h in features(data, starts, ends):
            maybe = np.flatnonzero(sieve[(h >> _U(64 - _BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(model.hashes, h[maybe]), len(model.hashes) - 1)
            hit = model.hashes[place] == h[maybe]
            np.maximum.at(best, rows[maybe[hit]], model.scores[place[hit]])
    whole = Hasher(data)(starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = whole[1:] == whole[:-1]
    again[of[:-1][of[:-1] < len(starts)]] = False  # a document's first word follows nothing
    best[again] = 0  # a word said over and over counts once
    hits = np.flatnonzero(best > 0)
    doc = np.searchsorted(of, hits, "right") - 1
    for d in np.unique(doc).tolist():
        mine = hits[doc == d] if len(offsets) < 64 else hits[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
        n = int(of[d + 1] - of[d])
        found = segments((mine - of[d]).tolist(), best[mine].tolist(), GAP)
        yield d, n, [(int(starts[of[d] + a] - offsets[d]), int(ends[of[d] + b] - offsets[d]), model.rate * s - model.log_k - math.log(n)) for a, b, s in found]


def excess_of(found: list[tuple[int, int, float]]) -> float:
    """The sum over significant segments, or the best one's (negative) excess."""
    some = [x for _, _, x in found if x > 0]
    return sum(some) if some else max(x for _, _, x in found)


def _counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Features that toxic documents of the sample hold, with the numbers of toxic and harmless documents, and the totals.

    Only those that three toxic documents or more hold, three times as often as harmless ones do, reach the driver: a
    third at most of the distinct features of the sample's toxic documents, whatever the corpus' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            hashes, ones = [], []
            for lo, _, data, offsets in blocks(batch.column(0)):
                data, starts, ends, of = tokens(data, offsets)
                doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
                for rows, h in features(data, starts, ends):
                    for kind in (False, True):
                        own = toxic[lo + doc[rows]] == kind
                        pairs = np.stack([h[own], doc[rows][own].astype(_U)], axis=1)
                        once = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                        if len(once):
                            once = once[np.append(True, (np.diff(once, axis=0) != 0).any(axis=1))]
                        hashes.append(once[:, 0])
                        ones.append(np.full(len(once), kind))
            h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
            t = np.concatenate(ones) if ones else np.zeros(0, bool)
            keys, place = np.unique(h, return_inverse=True)
            yes = np.bincount(place[t], minlength=len(keys))
            no = np.bincount(place[~t], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(yes), pa.array(no)], ["h", "yes", "no"])

    found = texts.select("text", "label").mapInArrow(trimmed(run), "h long, yes long, no long").groupBy("h").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    totals = found.agg(F.sum("yes"), F.sum("no")).first()
    n_yes, n_no = float(totals[0] or 0), float(totals[1] or 0)
    likely = found.filter((F.col("yes") >= 3) & (F.col("yes") * F.lit(max(n_no, 1.0)) > 3 * F.col("no") * F.lit(max(n_yes, 1.0))))
    rows = likely.toPandas()
    return rows["h"].to_numpy(np.int64).view(_U), rows["yes"].to_numpy(float), rows["no"].to_numpy(float), n_yes, n_no


def log_odds(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float, strength: float = 0.1) -> np.ndarray:
    """Log-odds with a Dirichlet prior of `strength` times the feature's own counts, less SURE standard errors."""
    prior = strength * (yes + no)
    mass = strength * (n_yes + n_no)
    a, b = yes + prior, no + prior
    value = np.log(a / (n_yes + mass - a)) - np.log(b / (n_no + mass - b))
    return value - SURE * np.sqrt(1 / a + 1 / b)


def rate_of(scores: np.ndarray, chances: np.ndarray, gap: float) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, where the rest of the probability lies on `gap`."""
    if not len(scores):
        return 1.0
    rest = max(1e-9, 1 - chances.sum())
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if (chances * np.exp(np.minimum(mid * scores, 600))).sum() + rest * math.exp(mid * gap) > 1:
            high = mid
        else:
            low = mid
    return low


def log_k_of(some: int | None, seen: float | None) -> float:
    """ln K of the extreme-value law P(best score <= s) = exp(-K n exp(-lambda s)), by maximum likelihood.

    `some` harmless texts have a positive segment, and `seen` is the sum over all of them of n exp(-lambda s), with s = 0
    for the others, of which the law only says that they stay at 0: K = some / seen. Without such texts K is 0.1.
    """
    return math.log(some / seen) if some and seen else math.log(0.1)


def fit(docs: DataFrame, labels: DataFrame, rows: Column, most: int = 20_000) -> Model:
    """Learn from about `most` labelled documents at most that `rows` (a predicate on labels) admits. Without toxic ones nothing scores."""
    texts = sample(docs, labels, "toxic", rows, most).select("doc_id", "text", "label").persist()
    h, yes, no, n_yes, n_no = _counts(texts)
    value = log_odds(yes, no, n_yes, n_no) if len(h) else np.zeros(0)
    keep = value > 0.5
    h, value, yes, no = h[keep], value[keep], yes[keep], no[keep]
    order = np.argsort(h)
    prior = 0.1 * (yes + no)
    chances = (no + prior) / max(1.0, n_no + 0.1 * (n_yes + n_no))
    model = Model(h[order], value[order], rate_of(value, chances, GAP), 0.0)
    harmless = texts.filter("label = 0")
    some, seen = _excesses(harmless, model, with_all=True).agg(F.count_if(F.col("_excess") > CLEAN), F.sum(F.exp(-F.least(F.lit(300.0), F.col("_best"))))).first()
    model.log_k = log_k_of(some, seen)
    got = _excesses(texts, model).select("label", F.col("_excess").alias("excess")).toPandas()
    texts.unpersist()
    x, y = got["excess"].to_numpy(float), got["label"].to_numpy(float)
    some = x > CLEAN
    model.slope, model.shift = _logistic(np.clip(x[some], -10, 20), y[some])
    model.clean = float((y[~some].sum() + 0.01) / (len(y) - some.sum() + 1))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope (never negative) and intercept by Newton steps on a ridge-penalised likelihood."""
    if not len(x):
        return 1.0, 0.0
    a, b = 0.5, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + 1e-3 * b])
        hess = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))


def _excesses(docs: DataFrame, model: Model, keep_text: bool = False, with_all: bool = False) -> DataFrame:
    """docs (without text unless kept) with excess, the best segment's own excess and the byte ranges and excesses of
    significant segments, under three names that docs doesn't use (see _added). `with_all` gives texts without a positive
    token the best excess of an empty segment, 0 tokens counting as 1."""
    ordered = docs.select(*[c for c in docs.columns if c != "text"], F.col("text").cast("string").alias("text"))
    kept = len(ordered.columns) - (not keep_text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("excess", pa.float64())]))
    names = _added(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = model.sieve()
        for batch in batches:
            excess = np.full(len(batch), CLEAN)
            best = np.zeros(len(batch))
            spans: list[list] = [[] for _ in range(len(batch))]
            for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                if with_all:
                    best[lo:hi] = -model.log_k - np.log(np.maximum(np.diff(tokens(data, offsets)[3]), 1))
                for d, _, found in passages(model, sieve, data, offsets):
                    excess[lo + d] = max(CLEAN + 1, excess_of(found))
                    best[lo + d] = max(x for _, _, x in found)
                    spans[lo + d] = [{"start": a, "stop": b, "excess": x} for a, b, x in found if x > 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(excess), pa.array(best), pa.array(spans, kind)], [*batch.schema.names[:kept], *names])

    more = StructType.fromDDL(f"{names[0]} double, {names[1]} double, {names[2]} array<struct<start:long,stop:long,excess:double>>")
    return ordered.mapInArrow(trimmed(run), StructType([*ordered.schema.fields[:kept], *more.fields]))


def _added(docs: DataFrame) -> list[str]:
    return [unused(docs.columns, n) for n in ("_excess", "_best", "_passages")]


def _score(model: Model, excess: Column) -> Column:
    raw = F.lit(model.slope) * F.least(F.lit(20.0), F.greatest(F.lit(-10.0), excess)) + F.lit(model.shift)
    curve = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), raw))))
    return F.when(excess > CLEAN, curve).otherwise(model.clean)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, excess, passages) of every whole text; null and blank texts have the score of a text without a toxic token. Repeated rows stay, no rows give none."""
    found = _excesses(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", _score(model, F.col("_excess")).alias("score"), F.col("_excess").alias("excess"), F.col("_passages").alias("passages"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns in their order, whatever their names."""
    return _excesses(docs, model, keep_text=True).filter(_score(model, F.col(_added(docs)[0])) < threshold).select(docs.columns)
