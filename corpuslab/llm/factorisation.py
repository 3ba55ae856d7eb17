"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

y(x) = w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]: the sum-of-squares identity gives all
pairwise interactions in time linear in the features present. Inputs are the shares of hashed words in a document, its
structure statistics and its length; labels, lang, source and doc_id are none. It is fitted on a bounded sample of
labelled rows, on the driver; scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._shared import trimmed, unused
from .labelled import sample
from .textbatch import Hasher, blocks, lower_latin, mix
from .textstats import Structure

_U = np.uint64
WORD_BUCKETS = 1 << 12
N_STATS = 14


def inputs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, offsets of documents in them, dense statistics) of a block.

    The words of a document are counted by bucket of their lower-case form; a value is the square root of the bucket's
    share, so that the vector has length one whatever the text's length.
    """
    s = Structure(data, offsets)
    bucket = (mix(Hasher(lower_latin(data))(s.starts, s.ends)) % _U(WORD_BUCKETS)).astype(np.int64)
    key, n = np.unique(s.doc * WORD_BUCKETS + bucket, return_counts=True)
    doc, index = key // WORD_BUCKETS, key % WORD_BUCKETS
    of = np.searchsorted(doc, np.arange(s.n_docs + 1))
    value = np.sqrt(n / np.maximum(s.n_words, 1)[doc])
    dense = np.concatenate([s.ratios(), np.log1p(s.chars)[:, None] / 12], axis=1)
    return index, value, of, dense


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # of words, then of statistics
    factors: np.ndarray  # features x rank
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, of: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.clip((dense - self.mean) / self.scale, -5, 5)
        words, stats = self.linear[:WORD_BUCKETS], self.linear[WORD_BUCKETS:]
        v, u = self.factors[:WORD_BUCKETS], self.factors[WORD_BUCKETS:]

        def total(x: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
            return run[of[1:]] - run[of[:-1]]

        sums = total(v[index] * value[:, None]) + z @ u
        squares = total((v * v)[index] * (value * value)[:, None]) + (z * z) @ (u * u)
        return self.bias + total(words[index] * value) + z @ stats + 0.5 * (sums * sums - squares).sum(axis=1)


def train(index: np.ndarray, value: np.ndarray, of: np.ndarray, dense: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 30, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Adagrad over mini-batches in a fixed order of draws; without two classes the machine answers with the labels' share."""
    rng = np.random.default_rng(seed)
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-3) if len(y) else (np.zeros(N_STATS), np.ones(N_STATS))
    share = (y.sum() + 0.5) / (len(y) + 1)
    size = WORD_BUCKETS + N_STATS
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, rank)), mean, scale)
    if len(y) == 0 or y.min() == y.max():
        return m
    z = np.clip((dense - mean) / scale, -5, 5)
    lengths = np.diff(of)
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    columns = np.arange(WORD_BUCKETS, size)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 256):
            rows = order[lo : lo + 256]
            n = lengths[rows]
            take = np.repeat(of[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            i = np.concatenate([index[take], np.tile(columns, len(rows))])
            x = np.concatenate([value[take], z[rows].ravel()])
            d = np.concatenate([np.repeat(np.arange(len(rows)), n), np.repeat(np.arange(len(rows)), N_STATS)])
            vx = m.factors[i] * x[:, None]
            sums = np.stack([np.bincount(d, vx[:, f], minlength=len(rows)) for f in range(rank)], axis=1)
            squares = np.bincount(d, (vx * vx).sum(axis=1), minlength=len(rows))
            logit = m.bias + np.bincount(d, m.linear[i] * x, minlength=len(rows)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            g_w = np.bincount(i, err[d] * x, minlength=size) + decay * m.linear
            g_v = np.stack([np.bincount(i, err[d] * x * (sums[d, f] - vx[:, f]), minlength=size) for f in range(rank)], axis=1) + decay * m.factors
            g_b = err.sum()
            seen_w, seen_v, seen_b = seen_w + g_w * g_w, seen_v + g_v * g_v, seen_b + g_b * g_b
            m.linear -= rate * g_w / np.sqrt(seen_w)
            m.factors -= rate * g_v / np.sqrt(seen_v)
            m.bias -= rate * g_b / np.sqrt(seen_b)
    return m


def fit(docs: DataFrame, labels: DataFrame, rows: Column, most: int = 5_000) -> Machine:
    """Learn from about `most` labelled documents at most that `rows` (a predicate on labels) admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                index, value, of, dense = inputs(data, offsets)
                packed = [
                    [index[a:b].astype("<u2").tobytes() for a, b in zip(of[:-1], of[1:], strict=True)],
                    [value[a:b].astype("<f4").tobytes() for a, b in zip(of[:-1], of[1:], strict=True)],
                    [row.astype("<f8").tobytes() for row in dense],
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "label", "i", "x", "z"])

    texts = sample(docs, labels, "quality", rows, most).select("doc_id", "text", "label")
    got = texts.mapInArrow(trimmed(run), "doc_id long, label long, i binary, x binary, z binary").toPandas().sort_values(["doc_id", "label"], kind="stable")
    index = [np.frombuffer(b, "<u2").astype(np.int64) for b in got["i"]]
    empty = [np.zeros(0)]
    return train(
        np.concatenate(index or empty).astype(np.int64),
        np.concatenate([np.frombuffer(b, "<f4").astype(float) for b in got["x"]] or empty),
        np.concatenate(([0], np.cumsum([len(i) for i in index]))).astype(np.int64),
        np.array([np.frombuffer(b, "<f8") for b in got["z"]]).reshape(-1, N_STATS),
        np.minimum(got["label"].to_numpy(float), 1.0),
    )


def _scored(docs: DataFrame, machine: Machine, name: str, keep_text: bool) -> DataFrame:
    """docs (without text unless kept) with their score as column `name`."""
    ordered = docs.select(*[c for c in docs.columns if c != "text"], F.col("text").cast("string").alias("text"))
    kept = len(ordered.columns) - (not keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(batch.num_columns - 1)):
                logit = machine.logits(*inputs(data, offsets))
                score = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:kept]), score], [*batch.schema.names[:kept], name])

    return ordered.mapInArrow(trimmed(run), StructType([*ordered.schema.fields[:kept], StructField(name, DoubleType())]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every whole text; a null text counts as empty and is scored like one. Repeated rows stay, no rows give none."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), machine, "score", False)


def of_quality(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns in their order, whatever their names."""
    name = unused(docs.columns, "_score")
    return _scored(docs, machine, name, True).filter(F.col(name) >= threshold).select(docs.columns)
