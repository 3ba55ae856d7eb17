"""Document fingerprints by randomised edit embedding.

All texts share one random walk rule: at step j a text whose current code point falls in class c stays if the shared bit
r(j, c) is 0 and moves on if it is 1; each step emits the current code point. Texts a few edits apart fall into step
again soon, so their emitted strings are near in Hamming distance, and unrelated ones are not. A fingerprint samples
that string: level k covers 64 * 2**k steps after those of the levels below it and keeps one bit from each 2**k of them.
The walk covers the whole text, whatever its length. Likeness weighs each sampled bit by the steps it stands for.

Bands of sampled bits find candidates for near duplicates; likeness verifies them. A band takes `BAND_BITS` bits from each
of two levels, so that texts which share their beginning only don't meet; `BANDS` bands lie on each pair of the last three
levels, so that an edit may spoil one of them. Where two texts differ in a share d of both levels' bits a band is equal
with probability (1 - d)**20 or a little less. A walk that ends inside its last level leaves the rest of that level's bits
at 0; a band takes part only if `LEAST_BITS` of its bits there lie before the walk's end, or texts that have nothing but
such zeros in common would meet. A text of one level takes its bits from that alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bucket_of, durable, lookup, range_bounds, width
from .components import connected_components
from .textbatch import blocks, mix

_U = np.uint64
PERIOD_BITS = 12
SAMPLES = 64
BLOCK = 3 << 20
BANDS, BAND_BITS, LEAST_BITS, TOP = 16, 10, 9, 3
CELL_MOST = 1 << 13
SMALL, FAR = 64, 20
FEW = 48  # this many walks or fewer advance one by one


def _advance_table() -> np.ndarray:
    """For each class and step (modulo the period): how many steps the walk stays on a code point of that class."""
    period = 1 << PERIOD_BITS
    bits = (mix(np.arange(256 << PERIOD_BITS, dtype=_U) + _U(0xED17)) & _U(1)).astype(bool).reshape(256, period)
    out = np.zeros((256, period), np.int32)
    twice = np.concatenate([bits, bits], axis=1)
    wait = np.zeros(256, np.int32)
    for j in range(2 * period - 1, -1, -1):
        wait = np.where(twice[:, j], 1, wait + 1)
        if j < period:
            out[:, j] = wait
    return out.ravel()


_ADVANCE = _advance_table()
_ADVANCE_BYTES = _ADVANCE.astype(np.uint8).tobytes()


def classes(cps: np.ndarray) -> np.ndarray:
    return (mix(cps.astype(_U) + _U(0xC1A5)) >> _U(56)).astype(np.uint8)


def walk(cls: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The step at which each text reaches each of its code points, and after them the step it ends on.

    Text d starts on step start[d]; its answers stand at offsets[d] + d ... offsets[d + 1] + d.
    """
    n = np.diff(offsets)
    out = np.zeros(len(cls) + len(n), np.int64)
    order = np.argsort(-n, kind="stable")
    begin, at = offsets[:-1][order], start[order].astype(np.int64)
    place = begin + order
    sizes = n[order]
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
    mask = (1 << PERIOD_BITS) - 1
    steps = int(np.count_nonzero(live > FEW))
    out[place] = at
    for i in range(steps):
        k = live[i]
        now = at[:k]
        now += _ADVANCE[(cls[begin[:k] + i].astype(np.int64) << PERIOD_BITS) | (now & mask)]
        out[place[:k] + i + 1] = now
    for d in range(int(live[steps]) if steps < len(live) else 0):
        j, lo = int(at[d]), int(begin[d])
        got = []
        for c in cls[lo + steps : lo + int(sizes[d])].tobytes():
            j += _ADVANCE_BYTES[(c << PERIOD_BITS) | (j & mask)]
            got.append(j)
        out[place[d] + steps + 1 : place[d] + int(sizes[d]) + 1] = got
    return out


def levels(steps: np.ndarray) -> np.ndarray:
    """How many levels the first `steps` steps touch."""
    whole = -(-steps // SAMPLES)
    return np.where(steps > 0, np.ceil(np.log2(whole + 1.0)), 0).astype(np.int64)


def _sampled(level: np.ndarray) -> np.ndarray:
    """The sampled steps of each given level, a row a level."""
    k = np.arange(SAMPLES, dtype=np.int64)
    jitter = (mix((level[:, None].astype(_U) << _U(8)) + k.astype(_U) + _U(0x5A)) % (_U(1) << level[:, None].astype(_U))).astype(np.int64)
    return SAMPLES * ((1 << level[:, None]) - 1) + (k << level[:, None]) + jitter


def fingerprint(cls: np.ndarray, offsets: np.ndarray, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits of every level of every text, offsets of texts in them, steps of each text)."""
    n = np.diff(offsets)
    docs = np.arange(len(n))
    total = reached[offsets[1:] + docs]
    per = levels(total)
    of = np.concatenate(([0], np.cumsum(per)))
    doc = np.repeat(docs, per)
    level = np.arange(of[-1]) - of[doc]
    wanted = _sampled(level)
    span = np.int64(1) << 40
    keys = reached + np.repeat(docs, n + 1) * span
    found = np.searchsorted(keys, (wanted + doc[:, None] * span).ravel(), "right").reshape(wanted.shape) - 1
    inside = wanted < total[doc][:, None]
    char = np.minimum(found - doc[:, None], max(len(cls) - 1, 0))
    emitted = cls[char] if len(cls) else np.zeros(wanted.shape, np.uint8)
    bit = (mix((emitted.astype(_U) << _U(48)) + wanted.astype(_U)) >> _U(63)) & inside
    return np.bitwise_or.reduce(bit << np.arange(SAMPLES, dtype=_U), axis=1) if of[-1] else np.zeros(0, _U), of, total


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Of two fingerprints (bits by level, steps): 1 for equal ones, about 0 for unrelated ones.

    A step that only one text has counts as a coin toss, as does the difference of unrelated code points.
    """
    (x, n), (y, m) = a, b
    most = max(n, m)
    if most == 0:
        return 1.0
    same = other = 0.0
    for k in range(max(len(x), len(y))):
        weight = float(1 << k)
        steps = _STEPS(k)
        both, either = steps < min(n, m), steps < most
        differ = np.uint64(x[k] ^ y[k]) if k < len(x) and k < len(y) else np.uint64(0)
        differ = ((differ >> np.arange(SAMPLES, dtype=_U)) & _U(1)).astype(bool) & both
        same += weight * (both.sum() - 2.0 * differ.sum())
        other += weight * either.sum()
    return max(0.0, min(1.0, same / other)) if other else 1.0


_known_steps: dict[int, np.ndarray] = {}


def _STEPS(level: int) -> np.ndarray:
    if level not in _known_steps:
        _known_steps[level] = _sampled(np.array([level]))[0]
    return _known_steps[level]


def likenesses(bits_a: np.ndarray, of_a: np.ndarray, n_a: np.ndarray, bits_b: np.ndarray, of_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """likeness() of row i of one set and row i of the other, for all rows at once."""
    rows = len(n_a)
    most, least = np.maximum(n_a, n_b), np.minimum(n_a, n_b)
    same, other = np.zeros(rows), np.zeros(rows)
    for k in range(int(max(np.diff(of_a).max(initial=0), np.diff(of_b).max(initial=0)))):
        steps = _STEPS(k)
        both = np.searchsorted(steps, least, "left")
        either = np.searchsorted(steps, most, "left")
        shared = np.flatnonzero((np.diff(of_a) > k) & (np.diff(of_b) > k))
        differ = np.zeros(rows)
        mask = np.where(both[shared] >= SAMPLES, ~_U(0), (_U(1) << np.minimum(both[shared], SAMPLES - 1).astype(_U)) - _U(1))
        differ[shared] = np.bitwise_count((bits_a[of_a[shared] + k] ^ bits_b[of_b[shared] + k]) & mask)
        same += float(1 << k) * (both - 2.0 * differ)
        other += float(1 << k) * either
    return np.where(other > 0, np.clip(same / np.maximum(other, 1), 0, 1), 1.0)


def texts(bits: np.ndarray, of: np.ndarray, total: np.ndarray) -> list[str]:
    """Fingerprints as text: the steps, then 16 hex digits a level."""
    raw = bits.astype(">u8").tobytes().hex()
    return [f"{n:x}:{raw[16 * a : 16 * b]}" for n, a, b in zip(total.tolist(), of[:-1].tolist(), of[1:].tolist(), strict=True)]


def parse(text: str) -> tuple[np.ndarray, int]:
    steps, _, raw = text.partition(":")
    return np.frombuffer(bytes.fromhex(raw), ">u8").astype(_U), int(steps, 16)


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return cps, np.searchsorted(leads, offsets)


def compare_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, list | np.ndarray]:
    """For every text of a block but the last: its fingerprint, that of its edited text, and their likenesses, the next text being the next row."""
    cps, of = _code_points(data, offsets)
    leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    cls = classes(cps)
    n = np.diff(of)
    rows = len(n) - 1
    reached = walk(cls, of, np.zeros(len(n), np.int64))
    bits, bits_of, total = fingerprint(cls, of, reached)
    cut = n[:-1] - n[:-1] // 4
    put = np.minimum(n[:-1] // 4, n[1:])
    # the edited texts: their walks go on from the cut
    more_of = np.concatenate(([0], np.cumsum(put)))
    more = cls[np.repeat(of[1:-1] - more_of[:-1], put) + np.arange(more_of[-1])] if rows else cls[:0]
    docs = np.arange(rows)
    went_on = walk(more, more_of, reached[of[:-2] + docs + cut] if rows else np.zeros(0, np.int64))
    size = cut + put
    edit_of = np.concatenate(([0], np.cumsum(size)))
    own = np.repeat(np.arange(rows), size)
    inner = np.arange(edit_of[-1]) - edit_of[own]
    old = inner < cut[own]
    source = np.where(old, of[own] + inner, of[own + 1] + inner - cut[own]) if rows else np.zeros(0, np.int64)
    edit_cls = cls[source]
    edit_reached = np.zeros(len(source) + rows, np.int64)
    edit_reached[np.flatnonzero(old) + own[old]] = reached[(of[own] + inner + own)[old]]
    spot = (edit_of[:-1] + docs + cut) if rows else np.zeros(0, np.int64)
    edit_reached[np.repeat(spot - (more_of[:-1] + docs), put + 1) + np.arange(len(went_on))] = went_on
    edit_bits, edit_bits_of, edit_total = fingerprint(edit_cls, edit_of, edit_reached)
    raw = data.tobytes()
    at, cut_at, put_at = leads[of[:-2]] if rows else [], leads[of[:-2] + cut] if rows else [], leads[of[1:-1] + put] if rows else []
    shas = [hashlib.sha256(raw[a:b] + raw[c:d]).hexdigest() for a, b, c, d in zip(at, cut_at, offsets[1:-1], put_at, strict=True)]
    trimmed = bits_of[: rows + 1]
    return {
        "n_chars": n[:-1],
        "edited_sha256": shas,
        "fingerprint": texts(bits, trimmed, total[:rows]),
        "edited_fingerprint": texts(edit_bits, edit_bits_of, edit_total),
        "near_edited": likenesses(bits, trimmed, total[:rows], edit_bits, edit_bits_of, edit_total),
        "near_next": likenesses(bits, trimmed, total[:rows], bits, bits_of[1:], total[1:]),
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text counts as empty (fingerprint "0:"), repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                cps, of = _code_points(data, offsets)
                cls = classes(cps)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts(*fingerprint(cls, of, walk(cls, of, np.zeros(hi - lo, np.int64)))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses to the edited text and to the next document.

    The order is ascending doc_id (missing ones first, equal ones by text); the first follows the last. The rows are
    dealt out by ranges of doc_id, and each range also gets the first row of the range after it. One text is its own
    next; no rows give no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = range_bounds(rows.select(key.alias("key")), "key", width(spark))
    rows = rows.withColumn("bucket", bucket_of(key, bounds))
    heads = sorted((r["bucket"], r["key"]) for r in rows.groupBy("bucket").agg(F.min(key).alias("key")).collect())
    for_bucket = [(key_, heads[i - 1][0]) for i, (_, key_) in enumerate(heads)]
    firsts = spark.createDataFrame(for_bucket, "head long, to int")
    extra = rows.join(F.broadcast(firsts), key == F.col("head")).groupBy("to").agg(F.min("text").alias("text"))
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(True).alias("extra"))
    ordered = rows.withColumn("extra", F.lit(False)).unionByName(extra).repartition(width(spark), "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            whole = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()[0]
            lo, n = 0, len(whole)
            lengths = np.diff(np.frombuffer(whole.column(1).buffers()[1], np.int32)[whole.column(1).offset : whole.column(1).offset + n + 1].astype(np.int64))
            ends = np.cumsum(lengths)
            while lo < n - 1:
                before = ends[lo - 1] if lo else 0
                hi = min(n - 1, max(lo + 1, int(np.searchsorted(ends, before + BLOCK, "right"))))
                part = whole.slice(lo, hi + 1 - lo)
                _, _, data, offsets = next(blocks(part.column(1), 1 << 62))
                got = compare_block(data, offsets)
                out = pa.RecordBatch.from_arrays([part.column(0).slice(0, hi - lo), *(pa.array(v) for v in got.values())], ["doc_id", *got])
                yield out.filter(pa.array(~part.column(2).slice(0, hi - lo).to_numpy(zero_copy_only=False)))
                lo = hi
            kept = whole.slice(n - 1)

    return ordered.select("doc_id", "text", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


@cache
def _bands() -> np.ndarray:
    """The mask of each band's bits on its level, then those on the level before."""
    chosen = np.argsort(mix(np.arange(2 * BANDS * SAMPLES, dtype=_U) + _U(0xBA4D)).reshape(2 * BANDS, SAMPLES), axis=1)[:, :BAND_BITS]
    return np.bitwise_or.reduce(_U(1) << chosen.astype(_U), axis=1)


def _whole_bands(level: int, total: int) -> np.ndarray:
    """The bands that a walk of `total` steps has on this level."""
    inside = int(np.searchsorted(_STEPS(level), total, "left"))
    if inside >= SAMPLES or level == 0:
        return np.arange(BANDS)
    known = (_U(1) << _U(inside)) - _U(1)
    return np.flatnonzero(np.bitwise_count(_bands()[:BANDS] & known) >= LEAST_BITS)


def _matrix(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, a row a fingerprint and a column a level, missing ones 0; steps)."""
    parsed = [parse(p) for p in prints]
    bits = np.zeros((len(parsed), max((len(b) for b, _ in parsed), default=0)), _U)
    for r, (b, _) in enumerate(parsed):
        bits[r, : len(b)] = b
    return bits, np.array([n for _, n in parsed], np.int64)


def _pairs_at(bits: np.ndarray, total: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """likeness() of rows i and j of a matrix, pair by pair."""
    most, least = np.maximum(total[i], total[j]), np.minimum(total[i], total[j])
    same, other = np.zeros(len(i)), np.zeros(len(i))
    for k in range(bits.shape[1]):
        steps = _STEPS(k)
        if not len(most) or steps[0] >= most.max():
            break
        both, either = np.searchsorted(steps, least, "left"), np.searchsorted(steps, most, "left")
        mask = np.where(both >= SAMPLES, ~_U(0), (_U(1) << np.minimum(both, SAMPLES - 1).astype(_U)) - _U(1))
        same += float(1 << k) * (both - 2.0 * np.bitwise_count((bits[i, k] ^ bits[j, k]) & mask))
        other += float(1 << k) * either
    return np.where(other > 0, np.clip(same / np.maximum(other, 1), 0, 1), 1.0)


def _forest(bits: np.ndarray, total: np.ndarray, rows: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Edges that span each component of the pairs of at least that likeness among rows of a matrix; a found one leaves the list, so dense cells end early."""
    left = rows
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _pairs_at(bits, total, np.full(len(left), at), left) >= least
            found = left[near].tolist()
            yield from ((at, x) for x in found)
            queue.extend(found)
            left = left[~near]


def _edges(table: pa.Table, least: float) -> pa.RecordBatch:
    """Edges inside each whole cell of a table (band, cell, part, node, fingerprint) sorted by cell. Small cells are compared at all distances in the list at once."""
    band, cell, part, node = (table.column(c).to_numpy() for c in ("band", "cell", "part", "node"))
    prints = table.column("fingerprint").combine_chunks().dictionary_encode()
    prints = prints.combine_chunks() if isinstance(prints, pa.ChunkedArray) else prints
    bits, total = _matrix(prints.dictionary.to_pylist())
    row = prints.indices.to_numpy()
    new = np.ones(len(node), bool)
    new[1:] = (np.diff(band) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    small = size[run] <= SMALL
    us, vs = [], []
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((run[:-step] == run[step:]) & small[:-step])
        if len(i):
            i = i[_pairs_at(bits, total, row[i], row[i + step]) >= least]
            us.append(node[i])
            vs.append(node[i + step])
    starts = np.flatnonzero(new)
    for k in np.flatnonzero(size > SMALL).tolist():
        own = np.arange(starts[k], starts[k] + size[k])
        who = {int(r): int(n) for r, n in zip(row[own], node[own], strict=True)}
        pairs = list(_forest(bits, total, row[own], least))
        us.append(np.array([who[a] for a, _ in pairs], np.int64))
        vs.append(np.array([who[b] for _, b in pairs], np.int64))
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us) if us else empty), pa.array(np.concatenate(vs) if vs else empty)], ["u", "v"])


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first `keys` columns in tables of whole cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        if held and any(held[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
        same = int(other[-1]) + 1 if len(other) else 0  # from here on the last cell, which may go on
        if same:
            yield pa.Table.from_batches([*held, batch.slice(0, same)])
            held = []
        held.append(batch.slice(same))
    if held:
        yield pa.Table.from_batches(held)


def _with_partners(table: pa.Table) -> pa.Table:
    """Of rows (band, cell, node, word, before) sorted by cell, whole cells: those with a partner in their cell whose two levels differ in at most FAR bits each, and all of cells of more than SMALL rows.

    Unrelated levels that share a band differ in 27 of the other 54 bits, so chance meetings end here.
    """
    band, cell = table.column(0).to_numpy(), table.column(1).to_numpy()
    words = [table.column(k).to_numpy().view(_U) for k in (3, 4)]
    new = np.ones(len(band), bool)
    new[1:] = (np.diff(band) != 0) | (np.diff(cell) != 0)
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    keep = size[run] > SMALL
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((run[:-step] == run[step:]) & ~(keep[:-step] & keep[step:]))
        if not len(i):
            continue
        for word in words:
            i = i[np.bitwise_count(word[i] ^ word[i + step]) <= FAR]
        keep[i] = keep[i + step] = True
    return table.select(["band", "cell", "node"]).filter(pa.array(keep)).combine_chunks()


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, class_id) for every row of docs; see with_classes."""
    return with_classes(durable(fingerprints(docs), "prints"), least)


def with_classes(found: DataFrame, least: float = 0.8) -> DataFrame:
    """found (doc_id, fingerprint and more, read several times) with class_id: the smallest doc_id reachable over candidates of at least that likeness.

    Equal fingerprints are one class. Rows without doc_id get the class of an equal fingerprint (null if there is none).
    A cell of more than `CELL_MOST` fingerprints is dealt out as pairs of its parts, so none of its pairs is lost.
    """
    own = durable(found.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).filter("node is not null"), "nodes")
    masks = _bands()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, prints = batch.column(1).to_numpy(), batch.column(0).to_pylist()
            cells, nodes, which, words, before = [], [], [], [], []
            for p, d in zip(prints, node.tolist(), strict=True):
                bits, total = parse(p)
                usable = [(level, k) for level in reversed(range(len(bits))) if len(k := _whole_bands(level, total))][:TOP]
                pairs = list(combinations(range(len(usable)), 2)) or [(0, 0)] * len(usable)
                for x, y in pairs:
                    (level, k), other = usable[x], usable[y][0]
                    word, prior = bits[level], bits[other]
                    cells.append(mix(mix(word & masks[k]) ^ (prior & masks[k + BANDS])))
                    which.append(k + ((level * 64) + other) * BANDS)
                    nodes.append(np.full(len(k), d))
                    words.append(np.full(len(k), word))
                    before.append(np.full(len(k), prior))
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which).astype(np.int32)), pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(nodes).astype(np.int64)), *(pa.array(np.concatenate(w).view(np.int64)) for w in (words, before))], ["band", "cell", "node", "word", "before"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, 2):
            yield from _with_partners(table).to_batches()

    spread = own.mapInArrow(keys, "band int, cell long, node long, word long, before long").repartition(width(found.sparkSession), "band", "cell").sortWithinPartitions("band", "cell")
    rows = durable(spread.mapInArrow(prune, "band int, cell long, node long"), "cells")
    sizes = rows.groupBy("band", "cell").agg(F.count("*").alias("size")).filter("size > 1")
    rows = lookup(rows, sizes, ["band", "cell"], "size").join(own.drop("copies"), "node")
    parts = F.ceil(F.col("size") * 2 / F.lit(CELL_MOST)).cast("int")
    dealt = F.pmod(F.xxhash64("fingerprint"), F.col("parts").cast("long")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    hot = rows.filter(F.col("size") > CELL_MOST).withColumn("parts", parts).withColumn("own", dealt).withColumn("part", F.explode(both)).drop("parts", "own")
    rows = rows.filter(F.col("size") <= CELL_MOST).withColumn("part", F.lit(0)).unionByName(hot).select("band", "cell", "part", "node", "fingerprint")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, 3):
            yield _edges(table, least)

    edges = rows.repartition(width(found.sparkSession), "band", "cell", "part").sortWithinPartitions("band", "cell", "part").mapInArrow(join, "u long, v long")
    groups = connected_components(edges)
    classes = own.join(groups, "node", "left").select("fingerprint", "copies", F.coalesce("component", "node").alias("class_id"))
    return lookup(found, durable(classes, "classes"), ["fingerprint"], "copies", "left").select(*found.columns, "class_id")
