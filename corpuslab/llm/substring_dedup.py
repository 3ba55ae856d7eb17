"""Removal of byte strings that stand earlier in the corpus, by Burrows-Wheeler interval expansion (bwt.py).

Every string of `length` bytes that also starts earlier (in a smaller document, or earlier in the same one) is removed
with all its bytes; it is judged on the input. The corpus is dealt out so that equal strings always meet:

1. Of equal texts only the first goes on; in the others every string stands earlier.
2. Each string is owned by its anchor, the least hash among its `GRAM`-byte grams (the first of equal ones). Equal
   strings own equal anchors, so an anchor that occurs once in the corpus rules all its strings out.
3. The pieces of text behind anchors that occur again meet by anchor. A task sends equal pieces once: the later ones
   stand earlier by definition. An anchor with more than `HOT` pieces sends its strings one by one, by their own hash,
   so that no anchor's pieces become one task's list.
4. Batches of whole anchors go through the Burrows-Wheeler transform, which tells the strings that stand earlier.
5. Their bytes are joined to runs per document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import durable, fresh_path, lookup, trimmed, unused, width
from .bwt import MOST, first_windows
from .textbatch import Hasher, blocks, mix

_U = np.uint64
GRAM = 24
HOT = 8192
BATCH = 1 << 20
SEEN_MOST = 400_000
LEAST = -(1 << 63)
POSITION_BITS = 31  # the same for every block: which of two grams is the least depends on the grams alone


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each byte on; beyond the end bytes count as 0."""
    base = 0x9E3779B97F4A7C15

    def joined(h: np.ndarray, have: int, later: np.ndarray) -> np.ndarray:
        """Hashes of the `have` bytes of h and those of later behind them."""
        shifted = later[have:] * _U(pow(base, have, 1 << 64))
        out = h.copy()
        out[: len(shifted)] += shifted
        return out

    part = data.astype(_U)
    part += _U(1)
    have, total, out = 1, 0, part
    while True:  # gram as a sum of powers of two
        if gram & have:
            out = joined(out, total, part) if total else part
            total += have
            if total == gram:
                return out
        part, have = joined(part, have, part), 2 * have


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first string, number of strings, anchor hash) of the runs of strings that own one anchor."""
    empty = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if not (size >= length).any():
        return empty, empty, empty, np.zeros(0, _U)
    h = mix(gram_hashes(data, gram))
    grams = length - gram + 1  # in a string
    # the least (hash, position) of each window, by windows of doubling size; the position breaks ties
    low = _U((1 << POSITION_BITS) - 1)
    least = h & ~low
    least |= np.arange(len(h), dtype=_U)
    have = 1
    while have < grams:
        step = min(have, grams - have)
        least[: len(least) - step] = np.minimum(least[: len(least) - step], least[step:])
        have += step
    mark = np.zeros(len(h) + 1, np.int8)  # no string starts at a document's last length - 1 bytes
    some = size > 0
    mark[np.maximum(offsets[1:] - length + 1, offsets[:-1])[some]] += 1
    mark[offsets[1:][some]] -= 1
    string = np.cumsum(mark[:-1], dtype=np.int8) == 0
    new = np.ones(len(h) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:-1])
    new[offsets[:-1][some]] = True
    new[1:-1] |= string[1:] != string[:-1]
    starts, stops = np.flatnonzero(new[:-1] & string), np.flatnonzero(new[1:] & string) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return doc, starts - offsets[doc], stops - starts, h[(least[starts] & low).astype(np.int64)]


def _again_in_block(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of these byte ranges, in the order given, equal one before."""
    _, first, place = np.unique(Hasher(data)(starts, stops), return_index=True, return_inverse=True)
    rows = np.flatnonzero(first[place] != np.arange(len(starts)))
    raw = data.tobytes()
    like = first[place[rows]]
    same = [raw[a:b] == raw[c:d] for a, b, c, d in zip(starts[rows].tolist(), stops[rows].tolist(), starts[like].tolist(), stops[like].tolist(), strict=True)]
    out = np.zeros(len(starts), bool)
    out[rows] = same
    return out


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor of texts in ascending order. A piece that equals an earlier one of its block is known to stand
    earlier; it is dealt out by its document instead of its anchor, so an anchor in very many places sends a row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, twin = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(2)):
                doc, first, count, h = anchors(data, offsets, length, gram)
                own = doc + lo
                ordered = np.lexsort((twin[own], number[own]))  # stable: strings of one text stay in order
                doc, first, count, h, own = doc[ordered], first[ordered], count[ordered], h[ordered], own[ordered]
                starts = offsets[doc] + first
                known = _again_in_block(data, starts, starts + count + length - 1)
                key = np.where(known, mix(number[own].view(_U) + first.astype(_U)), h).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(number[own]), pa.array(twin[own]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(known)],
                    ["anchor", "doc", "twin", "first", "n", "known"],
                )

    return texts.select("doc", "twin", "text").mapInArrow(trimmed(run), "anchor long, doc long, twin int, first int, n int, known boolean")


def _recurring(rows: DataFrame, most: int = HOT) -> DataFrame:
    """Rows whose anchor occurs again, from rows sorted by anchor; hot if more than `most` share it. Holds about `most` rows at most."""
    schema = "anchor long, doc long, twin int, first int, n int, known boolean, hot boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows, hot = 0, False

        def out(parts: list[pa.RecordBatch], is_hot: bool) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), is_hot))], ["anchor", "doc", "twin", "first", "n", "known", "hot"])

        for batch in batches:
            known = batch.column(5)
            if pc.any(known).as_py():
                yield from out([batch.filter(known)], False)
                batch = batch.filter(pc.invert(known))
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != key[0] or hot and held_key != key[0]:
                if held_rows > 1 and not hot:
                    yield from out(held, False)
                held, held_rows, hot = [], 0, False
            starts = np.flatnonzero(np.append(True, np.diff(key) != 0))
            size = np.diff(np.append(starts, len(key)))
            tail = int(starts[-1])
            head = int(size[0]) if len(starts) > 1 else 0
            if head:  # the first anchor ends here
                if hot:
                    yield from out([batch.slice(0, head)], True)
                elif held_rows + head > 1:
                    yield from out([*held, batch.slice(0, head)], held_rows + head > most)
                held, held_rows, hot = [], 0, False
                inner = np.repeat(size[1:-1], size[1:-1])
                body = batch.slice(head, tail - head)
                for is_hot in (False, True):
                    keep = (inner > 1) & ((inner > most) == is_hot)
                    if keep.any():
                        yield from out([body.filter(pa.array(keep))], is_hot)
            last = batch.slice(tail if len(starts) > 1 else 0)
            if hot:
                yield from out([last], True)
            else:
                held.append(last)
                held_rows += len(last)
                if held_rows > most:
                    yield from out(held, True)
                    held, hot = [], True
            held_key = key[-1]
        if held and held_rows > 1 and not hot:
            yield from out(held, False)

    return rows.mapInArrow(trimmed(run), schema)


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """Pieces (anchor, piece) of texts with their recurring anchors; a piece that this task has sent before for an earlier place comes without text: its strings stand earlier."""
    schema = "anchor long, piece binary, doc long, twin int, first int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            data_of = batch.column(2)
            docs, twins = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            groups = batch.column(3)
            flat = groups.flatten()
            bounds = groups.offsets.to_numpy()
            bounds = bounds - bounds[0]
            of_twin, anchor, first, n, known, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("twin", "anchor", "first", "n", "known", "hot"))
            rows: list[tuple] = []
            for r in range(len(batch)):
                raw = data_of[r].as_buffer().to_pybytes()
                doc, twin = docs[r], twins[r]
                lo, hi = int(bounds[r]), int(bounds[r + 1])
                some = []
                for t, a, f, m, is_known, is_hot in zip(*(x[lo:hi].tolist() for x in (of_twin, anchor, first, n, known, hot)), strict=True):
                    if t != twin:
                        continue
                    if is_known:
                        rows.append((a, None, doc, twin, f, m))
                    elif is_hot:
                        some += [(None, f + k, 1) for k in range(m)]
                    else:
                        some.append((a, f, m))
                some.sort(key=lambda x: x[1])
                for a, f, m in some:
                    piece = raw[f : f + m + length - 1]
                    digest = xxhash.xxh3_128_digest(piece)
                    if a is None:
                        a = int.from_bytes(digest[:8], "little", signed=True)
                    before = seen.get(digest)
                    if before is not None and before < (doc, twin, f):
                        rows.append((a, None, doc, twin, f, m))
                        continue
                    if before is None and len(seen) >= SEEN_MOST:
                        seen.clear()
                    seen[digest] = (doc, twin, f)
                    rows.append((a, piece, doc, twin, f, m))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "piece", "doc", "twin", "first", "n"])

    return texts.mapInArrow(trimmed(run), schema)


def whole_anchors(batches: Iterator[pa.RecordBatch], full: int = BATCH, most: int = MOST - 1) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables of whole anchors: of `full` bytes of pieces or a little more, and of more than `most` only if one anchor alone has more."""
    held: list[pa.RecordBatch] = []  # whole anchors
    last: list[pa.RecordBatch] = []  # the anchor that may go on
    size = last_size = 0
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
        ends = np.append(np.flatnonzero(np.diff(key) != 0) + 1, len(key)).tolist()
        begin = 0
        if last:
            if last[-1].column(0)[-1].as_py() == key[0]:
                begin = ends.pop(0)
                last.append(batch.slice(0, begin))
                last_size += int(sizes[begin])
                if not ends:
                    continue
            if held and size + last_size > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held, size, last = held + last, size + last_size, []
            if size >= full:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        tail = ends[-2] if len(ends) > 1 else begin
        before = begin
        for hi in ends[:-1]:
            if size + sizes[hi] - sizes[begin] > most and (held or before > begin):
                yield pa.Table.from_batches([*held, batch.slice(begin, before - begin)])
                held, size, begin = [], 0, before
            if size + sizes[hi] - sizes[begin] >= full:
                yield pa.Table.from_batches([*held, batch.slice(begin, hi - begin)])
                held, size, begin = [], 0, hi
            before = hi
        if tail > begin:
            held.append(batch.slice(begin, tail - begin))
            size += int(sizes[tail] - sizes[begin])
        last, last_size = [batch.slice(tail)], int(sizes[-1] - sizes[tail])
    if held and size + last_size > most:
        yield pa.Table.from_batches(held)
        held = []
    if held or last:
        yield pa.Table.from_batches(held + last)


def _standing_earlier(pieces: DataFrame, length: int) -> DataFrame:
    """Byte runs (doc, twin, start, stop) of the strings that stand earlier, from pieces sorted by anchor."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        doc, twin, first, n = (table.column(c).to_numpy() for c in ("doc", "twin", "first", "n"))
        piece = table.column("piece").to_pylist()
        empty = np.array([p is None for p in piece])
        once: set[bytes] = set()
        for r in np.lexsort((first, twin, doc)).tolist():  # of equal pieces the first is judged, the others stand later
            if not empty[r]:
                if piece[r] in once:
                    empty[r] = True
                else:
                    once.add(piece[r])
        d, t, s, e = [doc[empty]], [twin[empty]], [first[empty]], [(first + n + length - 1)[empty]]
        full = np.flatnonzero(~empty)
        if len(full):
            rank = np.empty(len(full), np.int64)
            rank[np.lexsort((first[full], twin[full], doc[full]))] = np.arange(len(full))
            flag = first_windows([piece[r] for r in full.tolist()], n[full].astype(np.int64), rank, length)
            own = np.repeat(full, n[full])
            offset = np.arange(len(flag)) - np.repeat(np.cumsum(n[full]) - n[full], n[full])
            new = flag.copy()
            new[1:] &= ~(flag[:-1] & (own[1:] == own[:-1]))
            end = flag.copy()
            end[:-1] &= ~(flag[1:] & (own[1:] == own[:-1]))
            a, b = np.flatnonzero(new), np.flatnonzero(end)
            d.append(doc[own[a]])
            t.append(twin[own[a]])
            s.append(first[own[a]] + offset[a])
            e.append(first[own[b]] + offset[b] + length)
        kinds = (np.int64, np.int32, np.int64, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k)) for x, k in zip((d, t, s, e), kinds, strict=True)], ["doc", "twin", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_anchors(batches):
            yield judge(table)

    return pieces.mapInArrow(trimmed(run), "doc long, twin int, start long, stop long")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _data() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, digest, text) of docs: doc_id with missing ones least, the digest of the text's bytes, and these (null: empty)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc"), F.sha2(_data(), 256).alias("digest"), _data().alias("text"))


def _stored(texts: DataFrame, parts: int) -> DataFrame:
    """texts in the shared folder, bucketed by doc: later joins on doc don't move them again."""
    spark = texts.sparkSession
    path = fresh_path(spark, "bucketed")
    name = f"corpuslab_{path.rsplit('-', 1)[1]}"
    texts.repartition(parts, "doc").write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, "doc").sortBy("doc").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return stored


def remove_repeated(docs: DataFrame, length: int = 100, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs; kept holds the bytes that stay, or null if all do.

    Texts are UTF-8 bytes, a null text is empty. Rows without doc_id come first in the order of documents; different
    texts under one doc_id are documents of their own, ordered by digest; equal texts under one doc_id are one document
    and all its rows get its result. No rows give no rows.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must lie in 1..length")
    hot = min(hot, (MOST - 1) // (2 * length - gram))  # an anchor's pieces fit one transform
    parts = width(docs.sparkSession)
    texts = _identified(docs)
    each = durable(texts.groupBy("doc", "digest").agg(F.count("*").alias("rows")), "digests")
    firsts = each.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    facts = F.struct("digest", (F.col("least") == F.col("doc")).alias("is_first"), "rows")
    by_doc = lookup(each, firsts, ["digest"], "n").groupBy("doc").agg(F.sort_array(F.collect_list(facts)).alias("facts"))
    if not each.filter("rows > 1").isEmpty():
        texts = texts.dropDuplicates(["doc", "digest"])
    twin = F.array_position(F.col("facts.digest"), F.col("digest")).cast("int")
    fact = F.element_at("facts", F.col("twin"))
    texts = texts.join(by_doc, "doc").withColumn("twin", twin).select("doc", "twin", "digest", fact["is_first"].alias("is_first"), fact["rows"].alias("rows"), "text")
    stored = _stored(texts, parts)
    chosen = stored.filter(F.col("is_first") & (F.octet_length("text") >= length)).select("doc", "twin", "text")
    again = _recurring(_anchor_rows(chosen, length, gram).repartition(parts, "anchor").sortWithinPartitions("anchor"), hot)
    grouped = again.groupBy("doc").agg(F.collect_list(F.struct("twin", "anchor", "first", "n", "known", "hot")).alias("anchors"))
    pieces = _pieces(chosen.join(grouped, "doc").select("doc", "twin", "text", "anchors"), length)
    spans = durable(_standing_earlier(pieces.repartition(parts, "anchor").sortWithinPartitions("anchor"), length), "spans")
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("twin", "start", "stop")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            text = batch.column(5)
            for r, (doc, twin, digest, is_first, spans) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6)), strict=True)):
                n = len(text[r].as_buffer())
                if not is_first and n >= length:
                    rows.append((doc, digest, n, n, 1, nothing, b""))
                    continue
                cut = _merged([(x["start"], x["stop"]) for x in spans or () if x["twin"] == twin])
                if not cut:
                    rows.append((doc, digest, n, 0, 0, digest, None))
                    continue
                raw = text[r].as_buffer().to_pybytes()
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cut)], [*(s for s, _ in cut), n], strict=True))
                rows.append((doc, digest, n, n - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(4)], [*_OUT, "rows"])

    found = stored.join(spans, "doc", "left").select("doc", "twin", "digest", "is_first", "rows", "text", "spans")
    found = found.mapInArrow(trimmed(run), "doc long, digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, rows long")
    found = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return found.select(F.nullif("doc", F.lit(LEAST)).alias("doc_id"), *_OUT[1:])


_OUT = ["doc", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def without_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """docs with each text cut down to what stays, with all their columns in their order, whatever their names.

    A code point that lost a byte goes whole. A text that nothing is cut from stays as it is, null included.
    """
    cut = remove_repeated(docs.select("doc_id", "text"), length, gram).filter("kept is not null")
    doc, digest, kept = (unused(docs.columns, n) for n in ("_doc", "_digest", "_kept"))
    cut = cut.select(F.coalesce("doc_id", F.lit(LEAST)).alias(doc), F.col("digest").alias(digest), F.col("kept").alias(kept)).dropDuplicates([doc, digest])

    @F.pandas_udf("string")
    def readable(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    known = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), digest: F.sha2(_data(), 256)})
    text = F.when(F.col(kept).isNull(), F.col("text")).otherwise(readable(kept))
    return known.join(cut, [doc, digest], "left").withColumn("text", text).select(docs.columns)
