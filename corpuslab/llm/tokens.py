"""Byte-level BPE ids of whole texts: the tokenizers library encodes each distinct pre-token once, numpy does the rest.

The pre-tokenizer's pattern is evaluated on arrays of code points, pre-tokens are told apart by 64-bit hashes, and a
bounded cache in each worker keeps the ids of those seen. A text with a code point whose class may differ between
Unicode versions goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Hasher, blocks

LETTER, NUMBER, SPACE, OTHER, UNSURE = 1, 2, 3, 4, 5
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # fixed values: White_Space
CACHE_MOST = 600_000
LINES = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _classes() -> np.ndarray:
    """The class of every code point; UNSURE if old and new Unicode data disagree or it isn't assigned."""
    kinds = {"L": LETTER, "N": NUMBER}
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, UNSURE, np.uint8)
    for cp in range(0x30000):
        a, b = unicodedata.category(chr(cp)), old(chr(cp))
        if a not in ("Cn", "Cs") and kinds.get(a[0], OTHER) == kinds.get(b[0], OTHER) and b != "Cn":
            out[cp] = kinds.get(a[0], OTHER)
    out[_WHITE] = SPACE
    out[[0x180E, 0x200B]] = UNSURE
    return out


def pretoken_starts(cps: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of consecutive documents start, by the published pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    white = (kind[runs] == SPACE) & ~border[ends]  # white space before something else in the same text
    last = ends[white] - 1
    start[last] = True
    start[ends[white][cps[last] == 0x20]] = False
    quote = runs[(cps[runs] == 0x27) & (ends - runs == 1) & ~border[ends]]
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = cps[quote + 1]
        two = np.where(border[np.minimum(quote + 2, n)], 0, cps[np.minimum(quote + 2, n - 1)])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        some = single | double
        start[quote[some] + 1] = False
        rest = quote[some] + 2 + double[some]
        rest = rest[rest < n]
        start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """Keeps the library's tokenizer and the ids of pre-tokens seen, up to CACHE_MOST of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, self.kind)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)
        return [np.asarray(e.ids, self.kind) for e in found]

    def _lines(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of pre-tokens that hold no white space but a space in front. They go to the library LINES at
        once, a line feed after each: that is a pre-token of its own, so its id tells where one ends."""
        flat = np.concatenate(self._encoded([b"\n".join(pieces[k : k + LINES]) + b"\n" for k in range(0, len(pieces), LINES)]))
        ends = np.flatnonzero(flat == self.feed)
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer doesn't keep line feeds apart")
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _add(self, hashes: list[int], pieces: list[bytes], lines: int) -> None:
        """The first `lines` of the pieces are fit for _lines()."""
        flat, sizes = self._lines(pieces[:lines]) if lines else (np.zeros(0, self.kind), np.zeros(0, np.int64))
        if lines < len(pieces):
            rest = self._encoded(pieces[lines:])
            flat, sizes = np.concatenate([flat, *rest]), np.append(sizes, [len(x) for x in rest])
        at = len(self.slots)
        while at + len(pieces) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.size[at : at + len(pieces)] = sizes
        self.start[at : at + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.slots.update(zip(hashes, range(at, at + len(pieces)), strict=True))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of whole documents, and the offsets of documents in them."""
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(n_docs + 1, np.int64)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        cp_offsets = np.searchsorted(leads, offsets)
        kind = _classes()[cps]
        starts = pretoken_starts(cps, kind, cp_offsets)
        of = np.searchsorted(starts, cp_offsets)
        begin = leads[starts]
        end = np.append(begin[1:], len(data))
        hashes = Hasher(data)(begin, end)
        codes, unique = pd.factorize(hashes)
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slots) + len(unique) > CACHE_MOST:
            self._clear()
        found = np.fromiter(map(self.slots.get, unique.tolist(), repeat(-1)), np.int64, len(unique))
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = data.tobytes()
            last = kind[np.append(starts[1:], len(cps))[first[new]] - 1]
            plain = (last != SPACE) & (last != UNSURE)
            new = np.concatenate((new[plain], new[~plain]))
            at = first[new]
            found[new] = np.arange(len(new)) + len(self.slots)
            self._add(unique[new].tolist(), [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], int(plain.sum()))
        slot = found[codes]
        size = self.size[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        id_offsets = total[of]
        unsure = np.unique(np.searchsorted(cp_offsets, np.flatnonzero(kind == UNSURE), "right") - 1)
        if len(unsure):
            parts = [ids[a:b] for a, b in zip(id_offsets[:-1], id_offsets[1:], strict=True)]
            for d in unsure.tolist():
                parts[d] = np.asarray(self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids, self.kind)
            ids = np.concatenate(parts)
            id_offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, id_offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _append(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """end_id after each document."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


def encoded(batch_text: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids with the end id, offsets) of each block of a text column."""
    encode = encoder(path)
    for lo, hi, data, offsets in blocks(batch_text):
        yield lo, hi, *_append(*encode(data, offsets), end_id)


def binaries(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary value a document, without a copy for each."""
    width = ids.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(ids.astype(ids.dtype.newbyteorder("<")).tobytes())])


def token_rows(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, width, ids): ids as little-endian unsigned integers of `width` bytes, with end_id last. A null text counts as empty; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, offsets in encoded(batch.column(1), path, end_id):
                wide = pa.array(np.full(hi - lo, ids.dtype.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), wide, binaries(ids, offsets)], ["doc_id", "n_tokens", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def unpack(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the offsets of rows in them."""
    kind = "<u2" if width == 2 else "<u4"
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // width
