"""How far each text of a group agrees with the others: n-grams are sorted once a group, not once a pair.

Texts come as Arrow rows sorted by group; equal texts of a group are one node, so copies aren't compared again. Counts are
exact: n-grams are numbers, not hashes. Memory holds a chunk of groups, or of one large group the pairs of some rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .overlap import CHARS, WORDS

MOST_SYMBOLS, MOST_PAIRS, MOST_MEETINGS = 1 << 16, 1 << 18, 1 << 18
COLUMNS = ("chrf", "f1", "precision", "peers")


def _dense(code: np.ndarray) -> tuple[np.ndarray, int]:
    distinct, place = np.unique(code, return_inverse=True)
    return place.astype(np.uint64), max(1, len(distinct))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins, and the length at the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))), [len(values)])) if len(values) else np.zeros(1, np.int64)


def _counts(codes: np.ndarray, offsets: np.ndarray, group: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """For n = 1 to `orders`: how many n-grams each node has, and (node, count, first, size) of each distinct n-gram of a
    node, where first and size say which stretch of these rows has the same n-gram in the same group."""
    nodes = len(offsets) - 1
    symbol, base = _dense(codes)
    owner = np.repeat(np.arange(nodes), np.diff(offsets))
    left = offsets[1:][owner] - np.arange(len(owner))  # symbols from here to the node's end
    code, most = symbol, base
    for n in range(1, orders + 1):
        if n > 1:
            if most * base >= 1 << 63:
                code, most = _dense(code)
            code, most = code[:-1] * np.uint64(base) + symbol[n - 1 :], most * base
        inside = left[: len(code)] >= n
        own = owner[: len(code)][inside]
        key, top = code[inside], most
        if top * max(1, nodes) >= 1 << 63:
            key, top = _dense(key)
        key = np.sort(key * np.uint64(max(1, nodes)) + own.astype(np.uint64))
        at = _runs(key)
        key = key[at[:-1]]
        node = (key % np.uint64(max(1, nodes))).astype(np.int64)
        gram, of = key // np.uint64(max(1, nodes)), group[node]
        begins = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((begins, [len(key)])))
        yield np.bincount(own, minlength=nodes), (node, np.diff(at), np.repeat(begins, size), np.repeat(size, size))


def _shared(rows: tuple[np.ndarray, ...], base: np.ndarray, place: np.ndarray, pairs: int, low: int, high: int) -> np.ndarray:
    """n-grams in common, with multiplicities, of each pair of a node from low to high and a node of its group."""
    node, count, first, size = rows
    out = np.zeros(pairs)
    some = np.flatnonzero((node >= low) & (node < high))
    ends = np.cumsum(size[some])
    cut = 0
    while cut < len(some):
        done = ends[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(ends, done + MOST_MEETINGS, "right")))
        part = some[cut:to]
        n = size[part]
        left = np.repeat(part, n)
        right = np.arange(len(left)) + np.repeat(first[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        out += np.bincount(base[node[left]] + place[node[right]], np.minimum(count[left], count[right]), pairs)
        cut = to
    return out


class _F2:
    """overlap.chrf_of() of arrays, one order after the other; what an order needs is let go after it."""

    def __init__(self, pairs: int):
        self.number, self.precision, self.recall = np.zeros(pairs, np.int32), np.zeros(pairs), np.zeros(pairs)

    def add(self, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> None:
        known = (x > 0) & (y > 0)
        self.number += known
        for to, total in ((self.precision, x), (self.recall, y)):
            to += np.where(known, common / np.maximum(total, 1), 0.0)

    def value(self) -> np.ndarray:
        number = np.maximum(1, self.number)
        p, r = self.precision / number, self.recall / number
        return np.where(p + r > 0, 5.0 * p * r / np.where(p + r > 0, 4.0 * p + r, 1.0), 0.0)


def _means(texts: list[tuple[np.ndarray, np.ndarray, int]], group: np.ndarray, known: np.ndarray, members: list[np.ndarray], most: int | None, low: int, high: int) -> dict[str, np.ndarray]:
    """COLUMNS of the nodes from low to high. texts: (symbols, each node's offset, orders) of letters, words and tokens
    (one order); known: false for nulls; members: for each group its rows' nodes, in order."""
    nodes = len(group)
    begins = np.searchsorted(group, group)
    width = np.searchsorted(group, group, "right") - begins
    base = np.zeros(nodes, np.int64)
    base[low:high] = np.cumsum(width[low:high]) - width[low:high]
    pairs = int(width[low:high].sum())
    a = np.repeat(np.arange(low, high), width[low:high])
    b = np.arange(pairs) - base[a] + begins[a]
    chrf, place = _F2(pairs), np.arange(nodes) - begins
    for codes, offsets, orders in texts[:-1]:
        for total, rows in _counts(codes, offsets, group, orders):
            chrf.add(total[a], total[b], _shared(rows, base, place, pairs, low, high))
    total, rows = next(_counts(*texts[-1][:2], group, 1))
    x, y, common = total[a], total[b], _shared(rows, base, place, pairs, low, high)
    both = (x > 0) & (y > 0)
    values = [chrf.value(), np.where(both, 2.0 * common / np.maximum(x + y, 1), 0.0), np.where(both, common / np.maximum(x, 1), 0.0)]
    copies = np.concatenate([np.bincount(m - m.min(), minlength=m.max() - m.min() + 1) for m in members])
    weight = np.where(known[a] & known[b] & (a != b), copies[b], 0)
    # without another prediction all of the group are peers, nulls too
    weight = np.where((np.bincount(a - low, weight, high - low)[a - low] == 0) & known[a], copies[b], weight)
    if most:
        weight = _spaced(weight, members, base, begins, width, group, most, low, high)
    peers = np.bincount(a - low, weight, high - low)
    return {c: np.bincount(a - low, weight * v, high - low) / np.maximum(peers, 1) for c, v in zip(COLUMNS, values, strict=False)} | {"peers": peers.astype(np.int64)}


def _spaced(weight: np.ndarray, members: list[np.ndarray], base: np.ndarray, begins: np.ndarray, width: np.ndarray, group: np.ndarray, most: int, low: int, high: int) -> np.ndarray:
    """The weights when of a node's peers only `most`, evenly spaced in their order, count."""
    out = np.zeros_like(weight)
    for node in range(low, high):
        rows = members[group[node]] - begins[node]
        rows = rows[weight[base[node] : base[node] + width[node]][rows] > 0]
        if len(rows) > most:
            rows = rows[np.unique(np.rint(np.arange(most) * ((len(rows) - 1) / max(most - 1, 1))).astype(np.int64))]
        out[base[node] : base[node] + width[node]] = np.bincount(rows, minlength=width[node])
    return out


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in column.to_pylist()]
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.dictionary_encode(pc.list_flatten(column), null_encoding="encode")
    return flat.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _of_chunk(chunk: pa.Table, ends: np.ndarray, text: str, parts: tuple[str, str, str], most: int | None) -> dict[str, np.ndarray]:
    """COLUMNS of each row of whole groups, which end at `ends`."""
    group = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    words = pc.dictionary_encode(chunk[text].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, node = np.unique(group * (words.max() + 1) + words, return_index=True, return_inverse=True)
    distinct = chunk.take(first)
    letters, pairs, tokens = (distinct[c].combine_chunks() for c in parts)
    texts = [(*_letters(letters), CHARS), (*_items(pairs), WORDS), (*_items(tokens), 1)]
    known = np.asarray(distinct[text].combine_chunks().is_valid())
    of, members = group[first], np.split(node, ends[:-1])
    width = np.searchsorted(of, of, "right") - np.searchsorted(of, of)
    found, low = [], 0
    while low < len(of):
        high = max(low + 1, int(np.searchsorted(np.cumsum(width[low:]), MOST_PAIRS, "right")) + low)
        found.append(_means(texts, of, known, members, most, low, high))
        low = high
    return {c: np.concatenate([f[c] for f in found])[node] for c in COLUMNS}


def agreed(batches: Iterator[pa.RecordBatch], keys: list[str], text: str, parts: tuple[str, str, str], most: int | None = None, keep: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The columns `keep` (else all but the letters and words) of the rows, with COLUMNS. `parts` are the text's letters, its
    words and its tokens. Rows of a group (keys) must stand together, in the order of their index; rows without a peer are
    left out."""
    schema = None
    for rows, ends in _groups(batches, keys):
        sizes = pc.utf8_length(rows[parts[0]].combine_chunks()).fill_null(0).to_numpy(zero_copy_only=False)
        so_far = np.cumsum(sizes)[ends - 1]
        begin = at = 0
        while at < len(ends):
            done = so_far[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(so_far, done + MOST_SYMBOLS, "right")))
            chunk = rows.slice(begin, int(ends[to - 1]) - begin)
            found = _of_chunk(chunk, ends[at:to] - begin, text, parts, most)
            out = chunk.drop_columns(list(parts[:2])) if keep is None else chunk.select(keep)
            for c in COLUMNS:
                out = out.append_column(c, pa.array(found[c]))
            out = out.filter(pa.array(found["peers"] > 0)).combine_chunks()
            schema = schema or out.schema
            yield from out.to_batches()
            begin, at = int(ends[to - 1]), to


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where each one ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.num_rows > 1 or len(held) > 1:
            table = pa.Table.from_batches(held)
            ends = _ends(table, keys)
            if len(ends) > 1:
                yield table.slice(0, int(ends[-2])).combine_chunks(), ends[:-1]
                held = table.slice(int(ends[-2])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _ends(table, keys)


def _ends(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the keys change, and the last row's end. Nulls are a key of their own."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        column = table[k].combine_chunks()
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
