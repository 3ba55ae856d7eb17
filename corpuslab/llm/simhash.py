"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check.

A fingerprint of 64 bits is embedded as the popcounts of its 32 two-bit segments. The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints, so two fingerprints within `distance` bits differ in at
most that many segments. The segments form twice as many groups as that; by the pigeonhole principle, embeddings that
are near agree wholly in at least half of the groups. The grid's cells are the popcounts of half of the groups, split by
these groups' bits: differing bits touch no more groups than differing segments do, so two near fingerprints still meet in
at least one cell, and strangers hardly ever. Inside a cell the Manhattan distance rejects first, then the Hamming
distance decides.

Only distinct fingerprints are joined, a cell gives a spanning forest rather than all its pairs, and a cell of more than
`CELL_MOST` fingerprints is dealt out as pairs of its parts, so that a large group of copies never becomes one task's
list and no link between different fingerprints is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, lookup, trimmed, width
from .components import connected_components
from .textbatch import blocks, lower_ascii, mix, words
from .xxh import xxh64

_U = np.uint64
_PAIRS = _U(0x5555555555555555)
CELL_MOST = 1 << 15
SHORT_RUN = 32


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each shingle in them, shingles of each document): `shingle` words of a document joined by single spaces, or all its words if it has fewer."""
    data = lower_ascii(data)
    starts, ends, of = words(data, offsets)
    n_docs = len(offsets) - 1
    if not len(starts):
        return data, starts, ends, np.zeros(n_docs, np.int64)
    # words of a document joined by single spaces: each word and the byte after it
    lengths = ends - starts + 1
    new_ends = np.cumsum(lengths) - 1
    new_starts = new_ends - (lengths - 1)
    take = np.arange(new_ends[-1] + 1) + np.repeat(starts - new_starts, lengths)
    joined = np.concatenate([data, np.full(1, 0x20, np.uint8)])[take]
    joined[new_ends] = 0x20
    n_words = np.diff(of)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    s_of = np.concatenate(([0], np.cumsum(n_shingles)))
    doc = np.repeat(np.arange(n_docs), n_shingles)
    first = of[doc] + np.arange(s_of[-1]) - s_of[doc]
    last = np.minimum(first + shingle, of[doc + 1]) - 1
    return joined, new_starts[first], new_ends[last], n_shingles


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed the fingerprints of the documents of a block."""
    joined, first, last, n_shingles = shingles_of(data, offsets, shingle)
    n_docs = len(offsets) - 1
    if not len(first):
        return [np.zeros(n_docs, _U) for _ in seeds]
    return [majority(xxh64(joined, first, last, seed), n_shingles) for seed in seeds]


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n[i] hashes the bits that over half of them have set; 0 for an empty run."""
    out = np.zeros(len(n), _U)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    of = np.concatenate(([0], np.cumsum(n)))
    # byte-wide counters, eight a word, over runs of at most 255
    pieces = -(-n[some] // 255)
    p_of = np.concatenate(([0], np.cumsum(pieces)))
    piece_doc = np.repeat(np.arange(len(some)), pieces)
    cuts = of[some][piece_doc] + 255 * (np.arange(p_of[-1]) - p_of[piece_doc])
    for bit in range(8):
        plane = (h >> _U(bit)) & _U(0x0101010101010101)
        counts = np.add.reduceat(plane, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes = np.add.reduceat(counts, p_of[:-1], axis=0)
        on = (2 * votes > n[some][:, None]).astype(_U)
        for byte in range(8):
            out[some] |= on[:, byte] << _U(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, fp0, fp1, ...) of whole texts, a fingerprint a seed; null texts count as empty, texts without words have fingerprint 0."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                found = fingerprints_of(data, offsets, shingle, seeds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(f.view(np.int64)) for f in found)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def embedding(fp: np.ndarray) -> np.ndarray:
    """Popcounts of the two-bit segments, two bits each in one word."""
    return fp - ((fp >> _U(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two embeddings: segments hold 0, 1 or 2, so |x - y| is 2 only between 0 and 2."""
    x = a ^ b
    high, low = (x >> _U(1)) & _PAIRS, x & _PAIRS
    return (np.bitwise_count(high & ~low & _PAIRS) * 2 + np.bitwise_count(low & ~high) + np.bitwise_count(high & low)).astype(np.int64)


def group_masks(distance: int) -> list[np.ndarray]:
    """For each choice of `distance` of twice as many groups of segments, the mask of their bits."""
    groups = 2 * distance
    bits = [_U(0)] * groups
    for segment in range(32):
        bits[segment % groups] |= _U(3) << _U(2 * segment)
    return [np.bitwise_or.reduce(np.array([bits[g] for g in chosen], _U)) for chosen in combinations(range(groups), distance)]


def _near(fp: np.ndarray, e: np.ndarray, i, j, distance: int) -> np.ndarray:
    """Whether rows i and j are near: the lower bound first, the exact distance where that allows it."""
    ok = manhattan(e[i], e[j]) <= distance
    ok &= np.bitwise_count(fp[i] ^ fp[j]) <= distance
    return ok


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Edges that span each component among these fingerprints; a found one leaves the list, so dense groups end early."""
    e, left = embedding(fp), np.arange(len(fp))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(fp, e, left, at, distance)
            found = left[near].tolist()
            if found:
                yield from ((at, x) for x in found)
                queue.extend(found)
                left = left[~near]


def _edges(table: pa.Table, distance: int) -> pa.RecordBatch:
    """Edges inside each whole cell of a table that is sorted by cell."""
    choice, cell, part = (table.column(c).to_numpy() for c in ("choice", "cell", "part"))
    fp, node = table.column("fp").to_numpy().view(_U), table.column("node").to_numpy()
    e = embedding(fp)
    new = np.ones(len(fp), bool)
    new[1:] = (np.diff(choice) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(fp)))
    run = np.cumsum(new) - 1
    us, vs = [], []
    short = size[run] <= SHORT_RUN
    for step in range(1, min(SHORT_RUN, int(size.max(initial=1)))):
        i = np.flatnonzero((run[:-step] == run[step:]) & short[:-step])
        i = i[_near(fp, e, i, i + step, distance)]
        us.append(node[i])
        vs.append(node[i + step])
    for k in np.flatnonzero(size > SHORT_RUN).tolist():
        lo, hi = starts[k], starts[k] + size[k]
        pairs = np.array(list(_forest(fp[lo:hi], distance)), np.int64).reshape(-1, 2) + lo
        us.append(node[pairs[:, 0]])
        vs.append(node[pairs[:, 1]])
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us) if us else empty), pa.array(np.concatenate(vs) if vs else empty)], ["u", "v"])


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (u, v) between nodes of classes (fp long, node long, and seed int if there are several; one row a fingerprint of a seed) that join the same nodes as all pairs of a seed within `distance` bits would."""
    masks = group_masks(distance)
    classes = classes if "seed" in classes.columns else classes.withColumn("seed", F.lit(0))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            e = embedding(fp)
            seed = batch.column(2).to_numpy(zero_copy_only=False) * len(masks)
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_arrays([pa.array((seed + k).astype(np.int32)), pa.array(mix(mix(e & mask) ^ (fp & mask)).view(np.int64)), batch.column(0), batch.column(1)], ["choice", "cell", "fp", "node"])

    rows = classes.select("fp", "node", "seed").mapInArrow(trimmed(cells), "choice int, cell long, fp long, node long")
    counts = rows.groupBy("choice", "cell").count().filter(F.col("count") > 1)
    rows = rows.join(counts, ["choice", "cell"])
    parts = F.ceil(F.col("count") * 2 / F.lit(CELL_MOST)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    hot = rows.filter(F.col("count") > CELL_MOST).withColumn("parts", parts).withColumn("own", own).withColumn("part", F.explode(pairs))
    rows = rows.filter(F.col("count") <= CELL_MOST).withColumn("part", F.lit(0)).select("choice", "cell", "part", "fp", "node").union(hot.select("choice", "cell", "part", "fp", "node"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = [batch.column(c).to_numpy() for c in range(3)]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            same = int(other[-1]) + 1 if len(other) else 0  # from here on the last cell, which may go on
            if kept and (same or any(kept[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(3))):
                yield _edges(pa.Table.from_batches([*kept, batch.slice(0, same)]), distance)
                kept = []
            elif same:
                yield _edges(pa.Table.from_batches([batch.slice(0, same)]), distance)
            kept.append(batch.slice(same))
        if kept:
            yield _edges(pa.Table.from_batches(kept), distance)

    spread = rows.repartition(width(classes.sparkSession), "choice", "cell", "part").sortWithinPartitions("choice", "cell", "part", "fp")
    return spread.mapInArrow(trimmed(join), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, seeds: tuple[int, ...] = (42,), distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; fp is the first seed's fingerprint.

    Two documents are linked if their fingerprints of any seed differ in at most `distance` bits; component_id is the
    smallest doc_id reachable. More seeds find more of the pairs that are similar but not almost equal. Null and blank
    texts share fingerprint 0 and are linked like any other. Repeated rows stay. A row without doc_id keeps its
    fingerprint and gets the component of documents that share all its fingerprints (null if there is none).
    """
    found = durable(fingerprints(docs, shingle, seeds), "fingerprints")
    names = found.columns[1:]
    classes = durable(found.groupBy(*names).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).filter("node is not null"), "classes")
    each = F.posexplode(F.array(*names)).alias("seed", "fp")
    flat = classes.select("node", each)
    own = flat.groupBy("seed", "fp").agg(F.min("node").alias("node"))
    edges = links(own, distance)
    if len(names) > 1:  # classes that share a fingerprint and differ in another
        first = own.withColumnRenamed("node", "v")
        edges = edges.union(flat.join(first, ["seed", "fp"]).filter("node <> v").select(F.col("node").alias("u"), "v"))
    groups = connected_components(edges)
    classes = classes.join(groups, "node", "left").select(*names, "copies", F.coalesce("component", "node").alias("component_id"))
    return lookup(found, durable(classes, "classes"), names, "copies", "left").select("doc_id", F.col(names[0]).alias("fp"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, seeds: tuple[int, ...] = tuple(range(42, 50)), distance: int = 3) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays, one row if it is repeated. Rows without doc_id stay; all columns stay in their order."""
    found = near_duplicates(docs, shingle, seeds, distance)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
