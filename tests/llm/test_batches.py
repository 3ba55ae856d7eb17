"""Batches of whole anchors never exceed what one transform can index."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import bwt, substring_dedup


def rows(anchors, per_batch):
    flat = [(a, bytes(n), a, 1, 0, 1) for a, pieces in enumerate(anchors) for n in pieces]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for k in range(0, len(flat), per_batch):
        columns = zip(*flat[k : k + per_batch], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "piece", "doc", "twin", "first", "n"])


@pytest.mark.parametrize("per_batch", [1000, 10_000, 100_000])
def test_a_batch_is_flushed_before_an_anchor_that_would_overflow_it(per_batch):
    anchors = [[100] * 10_485, [176] * 8192, [100] * 5, [176] * 8192, [176] * 8192, [100] * 10]
    tables = list(substring_dedup.whole_anchors(rows(anchors, per_batch)))
    assert all(sum(len(p) for p in t.column("piece").to_pylist()) < bwt.MOST for t in tables)
    assert [a for t in tables for a in t.column("anchor").to_pylist()] == [a for a, pieces in enumerate(anchors) for _ in pieces]


def test_batches_hold_whole_anchors():
    rng = random.Random(2)
    for _ in range(300):
        anchors = [[rng.randint(1, 9) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 12))]
        tables = list(substring_dedup.whole_anchors(rows(anchors, rng.randint(1, 9)), 30, 60))
        seen = [t.column("anchor").to_pylist() for t in tables]
        assert sum(seen, []) == [a for a, pieces in enumerate(anchors) for _ in pieces]
        assert all(x[-1] != y[0] for x, y in zip(seen, seen[1:], strict=False))
        assert all(sum(len(p) for p in t.column("piece").to_pylist()) <= 60 for t in tables)


def test_too_long_a_text_is_refused():
    pieces = [bytes(200)] * (bwt.MOST // 200 + 1)
    with pytest.raises(ValueError):
        bwt.first_windows(pieces, np.full(len(pieces), 101), np.arange(len(pieces)), 100)
