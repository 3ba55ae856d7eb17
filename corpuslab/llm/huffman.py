"""Token-id files: canonical length-limited Huffman codes from global counts, table-driven decoding of independent blocks.

A dataset is two Parquet folders. `codebook` holds one row: the code length of every id. `blocks` holds rows of whole
documents in ascending order: the documents' ids and lengths, the global number of tokens before the block, the code
bits, and the bit offset of every `STEP`-th token. Code bits can't be compressed further, so they are stored plain. A
reader decodes a block from its own row and the codebook; inside a block all checkpoints advance together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bucket_of, durable, range_bounds, width
from .tokens import token_rows, unpack

LIMIT = 16
STEP = 256
BLOCK_TOKENS = 1 << 16
_BLOCK_SCHEMA = "bucket int, block int, first_token long, n_tokens long, doc_ids array<long>, lengths array<long>, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for an id that never occurs."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    # each level: the merged list of coins and packages; kinds tell coins from packages
    kinds: list[np.ndarray] = []
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        place = np.argsort(merged, kind="stable")
        kinds.append(place < n)
        merged = merged[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for coins in reversed(kinds):
        chosen = int(coins[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each id, id of each LIMIT-bit window, length of each LIMIT-bit window): codes ascend by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    span = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
    first = np.cumsum(span) - span
    code = np.zeros(len(lengths), np.uint32)
    code[order] = first >> (LIMIT - lengths[order].astype(np.int64))
    total = int(span.sum())
    window_id, window_length = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    window_id[:total] = np.repeat(order, span)
    window_length[:total] = np.repeat(lengths[order], span)
    return code, window_id, window_length


def pack(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code bits of ids, most significant first, and the bit offset of every STEP-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    wide = code[ids].astype(np.int64) << (24 - size - (starts & 7))
    out = np.zeros((total + 7) // 8 + 2, np.float64)
    for k in range(3):  # codes share no bit, so sums are unions
        part = np.bincount((starts >> 3) + k, (wide >> (16 - 8 * k)) & 255, minlength=len(out))
        out += part[: len(out)]
    return out[: (total + 7) // 8].astype(np.uint8), starts[::STEP].astype(np.int64)


def unpack_bits(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window_id: np.ndarray, window_length: np.ndarray) -> np.ndarray:
    """Decode lanes of `sizes` tokens from bit offsets `starts`; the lanes advance together."""
    lanes = len(starts)
    if not lanes:
        return np.zeros(0, np.uint32)
    padded = np.concatenate([bits, np.zeros(8, np.uint8)])
    words = np.ndarray(len(bits) + 4, ">u4", padded, strides=(1,))
    order = np.argsort(-sizes, kind="stable")
    at = starts[order].copy()
    grid = np.zeros((int(sizes.max()), lanes), np.uint32)
    live = np.searchsorted(-sizes[order], -np.arange(1, len(grid) + 1), "right")
    for k in range(len(grid)):
        now = at[: live[k]]
        window = (words[now >> 3].astype(np.int64) >> (16 - (now & 7))) & 0xFFFF
        grid[k, : live[k]] = window_id[window]
        now += window_length[window]
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    lane = np.repeat(back, sizes)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return grid[step, lane]


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often every id occurs over all rows; a task sends one sum an id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            found = np.bincount(unpack(batch.column(1), batch.column(0)[0].as_py())[0])
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode whole texts, end each with end_id and write them to `path` in ascending doc_id order.

    Rows without doc_id come first; equal doc_ids stand side by side, ordered by their ids. The tokens are kept once in
    the shared folder; order comes from ranges of doc_id, of which only the sums go through the driver.
    """
    spark = docs.sparkSession
    tokens = durable(token_rows(docs, tokenizer, end_id), "tokens")
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds = range_bounds(tokens.select(key.alias("key")), "key", width(spark))
    tokens = tokens.withColumn("bucket", bucket_of(key, bounds))
    sums = dict(tokens.groupBy("bucket").agg(F.sum("n_tokens")).collect())
    base, before = {}, 0
    for b in sorted(sums):
        base[b] = before
        before += sums[b]
    lengths = code_lengths(id_counts(tokens))
    spark.createDataFrame([(LIMIT, STEP, bytearray(lengths.tobytes()))], "max_bits int, step int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    code = canonical(lengths)[0]

    def block(bucket: int, number: int, first: int, ids_of: list[int | None], parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        bits, marks = pack(ids, code, lengths)
        values = [bucket, number, first, len(ids), ids_of, [len(p) for p in parts], bits.tobytes(), marks.astype("<i8").tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["bucket", "block", "first_token", "n_tokens", "doc_ids", "lengths", "bits", "checkpoints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, first, size = None, 0, 0, 0
        ids_of: list[int | None] = []
        parts: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            flat, offsets = unpack(batch.column(3), batch.column(2)[0].as_py())
            for doc, b, lo, hi in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if parts and (b != bucket or size >= BLOCK_TOKENS):
                    yield block(bucket, number, first, ids_of, parts)
                    number, first, size, ids_of, parts = number + 1, first + size, 0, [], []
                if b != bucket:
                    bucket, number, first = b, 0, base[b]
                ids_of.append(doc)
                parts.append(flat[lo:hi])
                size += hi - lo
        if parts:
            yield block(bucket, number, first, ids_of, parts)

    ordered = tokens.select("bucket", "doc_id", "width", "ids").repartition(width(spark), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    ordered.mapInArrow(run, _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in the files; ids are little-endian unsigned 32-bit integers."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"]), np.uint8)
    _, window_id, window_length = canonical(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            for r in range(len(batch)):
                first, n = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                size = batch.column(3)[r].values.to_numpy()
                bits = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8)
                marks = np.frombuffer(batch.column(5)[r].as_buffer(), "<i8")
                lanes = np.minimum(STEP, n - STEP * np.arange(len(marks)))
                ids = unpack_bits(bits, marks, lanes, window_id, window_length).astype("<u4")
                ends = np.cumsum(size)
                raw = memoryview(ids).cast("B")
                texts = [raw[4 * a : 4 * b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
                crc = [zlib.crc32(t) for t in texts]
                offsets = np.concatenate(([0], 4 * ends)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(2)[r].values, pa.array(first + ends - size), pa.array(size), packed, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    return blocks.select("first_token", "n_tokens", "doc_ids", "lengths", "bits", "checkpoints").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
