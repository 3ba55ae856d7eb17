"""Packing along a space-filling curve.

Each document's token ids are projected to `DIMS` numbers by fixed random signs per id, the numbers are brought to
corpus-wide mean and spread, cut to `BITS` bits and joined to a Hilbert key. Documents are range-sorted by key and laid
end to end; the stream is cut every `size` tokens, so neighbours on the curve share sequences and nothing is padded:
what is left after the last full sequence becomes sequences whose sizes are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, durable, range_bounds, trimmed, width
from .textbatch import mix
from .tokens import binaries, encoded, unpack

_U = np.uint64
DIMS, BITS = 4, 8
_PROJECTED = [f"p{d}" for d in range(DIMS)]


def projection(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of DIMS numbers a document: sums of signs that depend on the id only, over the root of the length."""
    signs = (mix(np.arange(int(ids.max(initial=0)) + 1, dtype=_U) + _U(0x5EED))[:, None] >> np.arange(DIMS, dtype=_U)) & _U(1)
    signs = signs.astype(np.float32) * 2 - 1
    n = np.diff(offsets)
    out = np.zeros((len(n), DIMS))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(signs[ids], offsets[some], axis=0) / np.sqrt(n[some])[:, None]
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points whose rows hold one coordinate of `bits` bits a dimension."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations from the top bit down
        low = bit - 1
        for d in range(dims):
            turn = (x[d] & bit) != 0
            swap = np.where(turn, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        carry ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def projected_tokens(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, width, ids, p0, p1, ...): ids with end_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offsets in encoded(batch.column(1), tokenizer, end_id):
                p = projection(ids, offsets)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(np.full(hi - lo, ids.dtype.itemsize, np.int32)), binaries(ids, offsets), *(pa.array(p[:, d]) for d in range(DIMS))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "width", "ids", *_PROJECTED])

    schema = "doc_id long, n_tokens long, width int, ids binary, " + ", ".join(f"{p} double" for p in _PROJECTED)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), schema)


def curve_key(tokens: DataFrame) -> Column:
    """The Hilbert key, from numbers brought to the corpus's mean and spread."""
    aggs = [a for p in _PROJECTED for a in (F.avg(p), F.stddev_pop(p))]
    got = [float(x or 0) for x in tokens.agg(*aggs).first()]
    mean, spread = np.array(got[::2]), np.array(got[1::2]) + 1e-9

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        z = (np.stack([c.to_numpy(float) for c in columns], axis=1) - mean) / spread
        level = 1 / (1 + np.exp(-1.7 * np.clip(z, -20, 20)))
        return pd.Series(hilbert(np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))

    return key(*_PROJECTED)


def sequence_starts(total: int, size: int) -> tuple[int, np.ndarray]:
    """(full sequences, starts of those after them): the rest is cut into falling powers of two."""
    full, rest = divmod(total, size)
    starts, at = [], full * size
    for b in reversed(range(size.bit_length())):
        if rest >> b & 1:
            starts.append(at)
            at += 1 << b
    return full, np.array(starts, np.int64)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of docs.

    A null text counts as empty and holds only end_id. Equal keys are ordered by a hash of doc_id, doc_id and ids, so a
    large group of copies spreads over many ranges. `size` must be a power of two. No rows give no pieces.
    """
    spark = docs.sparkSession
    tokens = durable(projected_tokens(docs, tokenizer, end_id), "packing")
    place = curve_key(tokens) * F.lit(1 << 31) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    placed = durable(tokens.select("n_tokens", place.alias("place")), "places")
    bounds = range_bounds(placed, "place", width(spark))
    sums = dict(placed.groupBy(bucket_of(F.col("place"), bounds).alias("bucket")).agg(F.sum("n_tokens")).collect())
    base, total = {}, 0
    for b in sorted(sums):
        base[b] = total
        total += sums[b]
    full, tail = sequence_starts(total, size)

    def sequence_of(at: np.ndarray) -> np.ndarray:
        return np.where(at < full * size, at // size, full - 1 + np.searchsorted(tail, at, "right"))

    def start_of(sequence: np.ndarray) -> np.ndarray:
        last = np.append(tail, total)
        return np.where(sequence < full, sequence * size, last[np.clip(sequence - full, 0, len(last) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for batch in batches:
            if not len(batch):
                continue
            flat, offsets = unpack(batch.column(3), batch.column(2)[0].as_py())
            buckets, n = batch.column(0).to_numpy(), np.diff(offsets)
            new = np.append(bucket is None or buckets[0] != bucket, buckets[1:] != buckets[:-1])
            run_of = np.cumsum(new)
            heads = np.flatnonzero(new)
            firsts = np.append(at, np.array([base[b] for b in buckets[heads].tolist()], np.int64))
            skipped = np.append(0, offsets[:-1][heads])
            begin = firsts[run_of] + offsets[:-1] - skipped[run_of]
            bucket, at = buckets[-1], int(begin[-1] + n[-1])
            first, last = sequence_of(begin), sequence_of(begin + n - 1)
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            left = np.maximum(start_of(sequence), begin[row])
            right = np.minimum(start_of(sequence + 1), (begin + n)[row])
            raw = memoryview(flat.astype("<u4")).cast("B")
            shift = offsets[:-1][row] - begin[row]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((left + shift).tolist(), (right + shift).tolist(), strict=True)]
            doc = batch.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [doc, *(pa.array(v) for v in (left - begin[row], right - left)), pa.array(crc, pa.int64()), *(pa.array(v) for v in (n[row], sequence, left - start_of(sequence)))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    rows = tokens.withColumn("place", place).withColumn("bucket", bucket_of(F.col("place"), bounds))
    ordered = rows.select("bucket", "doc_id", "width", "ids", "place").repartition(width(spark), "bucket").sortWithinPartitions("bucket", "place", "doc_id", "ids")
    return ordered.drop("place").mapInArrow(trimmed(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
