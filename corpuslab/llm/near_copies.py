"""Near copies: SimHash links and shared minima give candidates, exact Jaccard similarity of word shingles decides.

Documents whose SimHash fingerprints (simhash.py, over the same shingles) lie within `DISTANCE` bits are candidates by
the grid join. At a similarity of 0.8 fingerprints differ in some 10 bits, beyond any grid's reach, so the rest of the
candidates share one of `BANDS` keys, each of `ROWS` minima of the set's hashes under shared random functions: a pair of
similarity j shares a key with probability 1 - (1 - j**ROWS)**BANDS, all but 4 in a million at 0.8. Equal sets are one
node. The candidates of a key are first held against the key's least node; after the links that this gives, only pairs of
different components are left to test, so a large group of copies costs its size and not its square. A parity sketch of
512 bits, whose Hamming distance never exceeds the sets' difference, rejects before texts move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, lookup, trimmed, width
from .components import connected_components
from .simhash import links, majority, shingles_of
from .textbatch import blocks, mix
from .xxh import xxh64

_U = np.uint64
BANDS, ROWS = 24, 4
DISTANCE = 3
SIMILAR = (4, 5)
SKETCH = [f"s{k}" for k in range(8)]
CELL_MOST = 1 << 14
PARTNERS = 2048
_rng = np.random.default_rng(0x5E7)
_FACTOR = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)) | np.uint32(1)
_TERM = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def hashes_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of each document of a block, repeats included, how many each has)."""
    joined, first, last, n = shingles_of(data, offsets, shingle)
    return (xxh64(joined, first, last, 42) if len(first) else np.zeros(0, _U)), n


def sets_of(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct hashes of each document in ascending order, offsets of documents in them)."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, a, b, n, fp, s0..s7, bands): the set's digest, its size, the SimHash fingerprint, the parity sketch and its keys; an empty set has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                every, repeats = hashes_of(data, offsets, shingle)
                fp = majority(every, repeats)
                h, of = sets_of(every, repeats)
                rows, n = hi - lo, np.diff(of)
                some = np.flatnonzero(n)
                cuts = of[some]
                a, b = np.zeros(rows, _U), np.zeros(rows, _U)
                keys = np.zeros((rows, BANDS), _U)
                if len(some):
                    a[some], b[some] = np.add.reduceat(mix(h), cuts), np.add.reduceat(mix(h ^ _U(0x9E3779B97F4A7C15)), cuts)
                    short = (h >> _U(32)).astype(np.uint32)
                    for band in range(BANDS):
                        key = np.full(len(some), band, _U)
                        for k in range(band * ROWS, (band + 1) * ROWS):
                            key = mix(key ^ np.minimum.reduceat(short * _FACTOR[k] + _TERM[k], cuts).astype(_U))
                        keys[some, band] = key
                doc = np.repeat(np.arange(rows), n)
                parity = np.bincount(doc * 512 + (h & _U(511)).astype(np.int64), minlength=rows * 512).reshape(rows, 512) & 1
                sketch = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(8)), bands],
                    ["doc_id", "a", "b", "n", "fp", *SKETCH, "bands"],
                )

    schema = "doc_id long, a long, b long, n long, fp long, " + ", ".join(f"{s} long" for s in SKETCH) + ", bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), schema)


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) that neither the sets' sizes nor their sketches rule out."""
    up, down = SIMILAR
    of = lambda end: nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", *SKETCH)))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    apart = sum((F.bit_count(F.col(f"u_{s}").bitwiseXOR(F.col(f"v_{s}"))) for s in SKETCH), F.lit(0))
    size = F.col("u_n") + F.col("v_n")
    near = (F.least("u_n", "v_n") * down >= F.greatest("u_n", "v_n") * up) & (apart * (down + up) <= size * (down - up))
    return both.filter(near).select("u", "v").distinct()


def similar(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Of the distinct pairs (u, v) of doc_ids those whose sets have a similarity of 4/5 or more; texts that share a doc_id are all tried."""
    up, down = SIMILAR
    spark = docs.sparkSession
    ends = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ends, "doc_id", "left_semi")
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    own = dealt.select("u", "part").distinct().join(texts.withColumnRenamed("doc_id", "u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
    other = dealt.join(texts.withColumnRenamed("doc_id", "v"), "v").select("u", "part", "v", "text")
    rows = own.union(other).repartition(width(spark), "u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, []
        for batch in batches:
            us, parts, vs = (batch.column(k).to_pylist() for k in range(3))
            found = set()
            for lo, hi, data, offsets in blocks(batch.column(3)):
                h, of = sets_of(*hashes_of(data, offsets, shingle))
                for r in range(lo, hi):
                    own = h[of[r - lo] : of[r - lo + 1]]
                    if at != (us[r], parts[r]):
                        at, mine = (us[r], parts[r]), []
                    if vs[r] is None:
                        mine.append(own.copy())
                        continue
                    for other in mine:
                        total = len(own) + len(other)
                        if total:
                            place = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
                            both = int(np.count_nonzero(other[place] == own)) if len(other) else 0
                            if both * (up + down) >= up * total:
                                found.add((us[r], vs[r]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(trimmed(run), "u long, v long").distinct()


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components in one cell that sizes and sketches admit, from rows (band, key, part, node, component, n, s0..s7) sorted by cell."""
    up, down = SIMILAR

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = [table.column(c).to_numpy() for c in ("band", "key", "part")]
        node, component, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
        sketch = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1).view(_U)
        new = np.ones(len(node), bool)
        new[1:] = np.logical_or.reduce([np.diff(c) != 0 for c in cell])
        starts = np.flatnonzero(new)
        us, vs, held = [], [], 0
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
            for i in range(lo, hi - 1):
                j = np.flatnonzero(component[i + 1 : hi] != component[i]) + i + 1
                j = j[np.minimum(n[j], n[i]) * down >= np.maximum(n[j], n[i]) * up]
                if not len(j):
                    continue
                apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                j = j[(apart * (down + up) <= (n[j] + n[i]) * (down - up)) & (node[j] != node[i])]
                us.append(np.minimum(node[j], node[i]))
                vs.append(np.maximum(node[j], node[i]))
                held += len(j)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                    us, vs, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = [batch.column(k).to_numpy() for k in range(3)]
            if held and any(held[-1].column(k)[-1].as_py() != key[k][0] for k in range(3)):
                yield from pairs(pa.Table.from_batches(held))
                held = []
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in key]))
            same = int(other[-1]) + 1 if len(other) else 0  # from here on the last cell, which may go on
            if same:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, same)]))
                held = []
            held.append(batch.slice(same))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    columns = ["band", "key", "part", "node", "component", "n", *SKETCH]
    spread = rows.select(columns).repartition(width(rows.sparkSession), "band", "key", "part").sortWithinPartitions("band", "key", "part")
    return spread.mapInArrow(trimmed(run), "u long, v long").distinct()


def components(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row of docs: the smallest doc_id reachable over pairs of similarity 4/5 or more.

    Null and blank texts have the empty set and are one class. A row without doc_id gets the component of documents with
    an equal set (null if there is none).
    """
    found = durable(signatures(docs, shingle), "signatures")
    facts = [F.min_by(F.struct("fp", *SKETCH, "bands"), "doc_id").alias("of")]
    own = found.filter("doc_id is not null").groupBy("a", "b", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *facts)
    own = durable(own.select("a", "b", "n", "copies", "node", "of.*"), "nodes")
    nodes = own.select("node", "n", "fp", *SKETCH, "bands")
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("size")), "prints")
    near = links(prints.select("fp", "node"), DISTANCE)
    same = lookup(nodes.select("fp", F.col("node").alias("v")), prints.filter("size > 1"), ["fp"], "size").filter("node <> v").select(F.col("node").alias("u"), "v")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("band", "key").agg(F.min("node").alias("head"), F.count("*").alias("size")).filter("size > 1")
    members = durable(lookup(rows, heads, ["band", "key"], "size"), "members")
    star = members.filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    star = durable(_likely(star.union(same).union(near).distinct(), nodes), "pairs")
    edges = durable(similar(star, docs, shingle), "edges")
    # what the stars leave: cells that hold several components
    groups = connected_components(edges)
    left = members.filter((F.col("size") > 2) & (F.col("node") != F.col("head"))).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    cells = left.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band", "key")
    left = left.join(cells, ["band", "key"]).join(nodes.drop("bands", "fp"), "node")
    parts = F.ceil(F.col("size") * 2 / F.lit(CELL_MOST)).cast("int")
    dealt = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    hot = left.filter(F.col("size") > CELL_MOST).withColumn("parts", parts).withColumn("own", dealt).withColumn("part", F.explode(both)).drop("parts", "own")
    left = left.filter(F.col("size") <= CELL_MOST).withColumn("part", F.lit(0)).unionByName(hot)
    across = durable(_across(left), "pairs")
    edges = edges.union(similar(across, docs, shingle))
    classes = own.select("a", "b", "n", "copies", "node").join(connected_components(edges), "node", "left").select("a", "b", "n", "copies", F.coalesce("component", "node").alias("component_id"))
    return lookup(found.select("doc_id", "a", "b", "n"), durable(classes, "classes"), ["a", "b", "n"], "copies", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near copies: of each component the row with the smallest doc_id stays, one row if it is repeated. Rows without doc_id stay, no rows give none; all columns stay in their order, whatever their names."""
    found = durable(components(docs, shingle), "components")
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null")).select(docs.columns)
