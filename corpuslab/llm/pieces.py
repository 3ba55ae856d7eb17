"""SentencePiece encoding and decoding in numpy: words of equal length advance together.

A text is cut where no piece can reach across: before a run of spaces and around code points that no piece holds. Of the
units in between, each distinct one is encoded once. Units of equal length form a matrix; at each position all substrings
that end there are hashed from prefix sums and probed in the sorted hashes of the pieces, and the best one by a
vectorised maximum is stored as back-pointer.

Unigram models maximise the sum of piece scores. A model of merges (BPE) has one right segmentation, whose prefixes are
right as well: there a candidate counts only if the merges leave it and the piece before it side by side, which a table
of piece pairs, filled as pairs turn up, tells. Either way ids equal the sentencepiece library's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import blocks, mix, sums_by
from .tokens import binaries, unpack

_U = np.uint64
_SPACE = 0x2581
UNIGRAM, BPE = 1, 2
CACHE_MOST = 600_000
BLOCK = 4 << 20
_BASE = _U(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model file's pieces. Only identity normalisation without extra-space removal is understood; others raise."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        rules = model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE) or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation and escaped white space are understood")
        self.dummy = rules.add_dummy_prefix
        kinds = np.array([p.type for p in model.pieces])
        if (kinds == 4).any():
            raise ValueError("user-defined symbols aren't understood")
        self.text = [p.piece for p in model.pieces]
        self.score = np.array([p.score for p in model.pieces], np.float64)
        self.unknown = int(np.flatnonzero(kinds == 2)[0])
        self.bytes = np.full(256, self.unknown, np.int64)
        raw = kinds == 6
        self.fallback = bool(raw.any())
        for i in np.flatnonzero(raw).tolist():
            self.bytes[int(self.text[i][3:5], 16)] = i
        normal = np.flatnonzero(kinds == 1)
        self.normal = {self.text[i]: i for i in normal.tolist()}
        self.longest = max((len(t) for t in self.normal), default=1)
        if any(chr(_SPACE) in t.lstrip(chr(_SPACE)) for t in self.normal):
            raise ValueError("a piece reaches across words")
        hashes = np.array([self.hash(np.array([[ord(c) for c in t]], _U))[0] for t in self.normal], _U)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.fromiter(self.normal.values(), np.int64, len(self.normal))[order]
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for t in self.normal for c in t]] = True
        if self.kind == BPE:  # a code point alone stays whole only if it is a piece
            self.known[:] = False
            self.known[[ord(t) for t in self.normal if len(t) == 1]] = True
        self.pairs: dict[int, bool] = {}
        self.width = np.uint16 if len(self.text) <= 1 << 16 else np.uint32
        # decoding: the bytes of every id
        spelled = [bytes([int(t[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else t.replace(chr(_SPACE), " ").encode() for t, k in zip(self.text, kinds.tolist(), strict=True)]
        self.spell_size = np.array([len(b) for b in spelled], np.int64)
        self.spell_start = np.cumsum(self.spell_size) - self.spell_size
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)

    @staticmethod
    def hash(cps: np.ndarray) -> np.ndarray:
        """Of each row of code points."""
        h = np.zeros(len(cps), _U)
        for k in range(cps.shape[1]):
            h = h * _BASE + (cps[:, k].astype(_U) + _U(1))
        return mix(h)

    def merged(self, text: str) -> list[int]:
        """Ids by merging: always the pair with the best score, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.normal.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.normal[p] for p in parts]

    def beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' text gives the two pieces; left -1 is the start of a unit."""
        keys, place = np.unique((left + 1) << 32 | right, return_inverse=True)
        got = np.empty(len(keys), bool)
        for k, key in enumerate(keys.tolist()):
            ok = self.pairs.get(key)
            if ok is None:
                a, b = (key >> 32) - 1, key & 0xFFFFFFFF
                want = [b] if a < 0 else [a, b]
                ok = self.pairs[key] = self.merged("".join(self.text[i] for i in want)) == want
            got[k] = ok
        return got[place]

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def segment(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in the rows of a matrix of known code points, and the number of ids of each row."""
        rows, n = cps.shape
        prefix = np.zeros((n + 1, rows), _U)
        power = [_U(1)]
        for k in range(n):
            prefix[k + 1] = prefix[k] * _BASE + (cps[:, k].astype(_U) + _U(1))
        for _ in range(min(n, self.longest)):
            power.append(_U(int(power[-1]) * int(_BASE) % (1 << 64)))
        last = np.full((n + 1, rows), -1, np.int64)  # the last piece of the best path to each position
        back = np.zeros((n + 1, rows), np.int32)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        unsure = np.zeros(rows, bool)
        lowest = self.score[self.ids].min(initial=0.0) - 10
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                at = end - size
                if self.kind == BPE:
                    r = np.flatnonzero((best[end] == -np.inf) & (best[at] == 0))
                    if not len(r):
                        continue
                    found = self.probe(mix(prefix[end, r] - prefix[at, r] * power[size]))
                    r, found = r[found >= 0], found[found >= 0]
                    if len(r):
                        ok = self.beside(last[at, r], found)
                        r, found = r[ok], found[ok]
                        best[end, r], last[end, r], back[end, r] = 0, found, size
                else:
                    found = self.probe(mix(prefix[end] - prefix[at] * power[size]))
                    value = np.where(found >= 0, best[at] + self.score[found], best[at] + lowest if size == 1 else -np.inf)
                    r = np.flatnonzero(value > best[end])
                    best[end, r], last[end, r], back[end, r] = value[r], np.where(found[r] >= 0, found[r], self.unknown), size
        unsure |= best[n] == -np.inf
        # follow the back-pointers of all rows together
        out = np.full((rows, n), -1, np.int64)
        at = np.where(unsure, 0, n)
        while True:
            r = np.flatnonzero(at > 0)
            if not len(r):
                break
            out[r, at[r] - 1] = last[at[r], r]
            at[r] -= back[at[r], r]
        for r in np.flatnonzero(unsure).tolist():  # no path: the merges themselves decide
            ids = self.merged("".join(map(chr, cps[r].tolist())))
            out[r, : len(ids)] = ids
        return out[out >= 0], (out >= 0).sum(axis=1)


class PieceEncoder:
    """Units of blocks, a bounded cache of those seen, and their ids."""

    def __init__(self, path: str):
        self.model = Pieces(path)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool: list[np.ndarray] = []
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.used = 0

    def _add(self, hashes: np.ndarray, cps: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        """Encode new units, lengths one after the other."""
        m = self.model
        order = np.argsort(length, kind="stable")
        starts, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n = int(length[rows[0]])
            for part in np.split(rows, range(max(1, 400_000 // n), len(rows), max(1, 400_000 // n))):
                matrix = cps[begin[part][:, None] + np.arange(n)]
                if n == 1 and not m.known[matrix[:, 0]].all():
                    found = [[m.normal[chr(c)]] if m.known[c] else m.bytes[list(chr(c).encode())].tolist() if m.fallback else [m.unknown] for c in matrix[:, 0].tolist()]
                    ids, count = np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found])
                else:
                    ids, count = m.segment(matrix)
                starts[part] = self.used + np.cumsum(count) - count
                sizes[part] = count
                self.pool.append(ids.astype(m.width))
                self.used += len(ids)
        at = len(self.slots)
        self.start, self.size = np.concatenate([self.start, starts]), np.concatenate([self.size, sizes])
        self.slots.update(zip(hashes.tolist(), range(at, at + len(hashes)), strict=True))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of whole documents, and the offsets of documents in them."""
        m = self.model
        n_docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, m.width), np.zeros(n_docs + 1, np.int64)
        cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").copy()
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        of = np.searchsorted(leads, offsets)
        cps[cps == 0x20] = _SPACE
        if m.dummy:  # a space before each text that isn't empty
            some = np.flatnonzero(np.diff(of))
            cps = np.insert(cps, of[some], _SPACE)
            of = of + np.concatenate(([0], np.cumsum(np.diff(of) > 0)))
        known = m.known[cps]
        space = cps == _SPACE
        start = np.ones(len(cps), bool)
        start[1:] = (space[1:] & ~space[:-1]) | ~known[1:] | ~known[:-1]
        start[of[of < len(cps)]] = True
        begin = np.flatnonzero(start)
        unit_of = np.searchsorted(begin, of)
        length = np.diff(np.append(begin, len(cps)))
        h = _hash_runs(cps, begin, length)
        codes, unique = pd.factorize(h)
        first = np.zeros(len(unique), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.slots) + len(unique) > CACHE_MOST:
            self._clear()
        new = np.array([i for i, x in enumerate(unique.tolist()) if x not in self.slots], np.int64)
        if len(new):
            self._add(unique[new], cps, begin[first[new]], length[first[new]])
            self.pool = [np.concatenate(self.pool)]
        slot = np.fromiter(map(self.slots.__getitem__, unique.tolist()), np.int64, len(unique))[codes]
        size = self.size[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[0][np.repeat(self.start[slot] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[unit_of]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the documents whose ids stand between offsets, and the documents' offsets in them."""
        m = self.model
        size = m.spell_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        data = m.spell[np.repeat(m.spell_start[ids] - total[:-1], size) + np.arange(total[-1])]
        of = total[offsets]
        if m.dummy and len(data):
            some = np.flatnonzero(np.diff(of))
            lead = of[some][data[of[some]] == 0x20]
            data = np.delete(data, lead)
            of = of - np.searchsorted(lead, of)
        return data, of


def _hash_runs(cps: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of code points, from prefix sums modulo 2**64."""
    from .textbatch import _table

    up, down = _table("up", len(cps)), _table("down", len(cps) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((cps.astype(_U) + _U(1)) * up)])
    return mix((sums[begin + length] - sums[begin]) * down[begin] + length.astype(_U))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, width, ids) of whole texts: ids as little-endian unsigned integers of `width` bytes. A null text counts as empty and has no ids; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                ids, of = work(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(of)), pa.array(np.full(hi - lo, ids.dtype.itemsize, np.int32)), binaries(ids, of)], ["doc_id", "n_pieces", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, width int, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            if len(batch):
                data, of = work.decode(*unpack(batch.column(2), batch.column(1)[0].as_py()))
                text = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(of.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "width", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, n_bytes, ids_crc32, restored): each text's ids by number and crc32 (as little-endian unsigned 32-bit integers), and whether decoding them gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1), BLOCK):
                ids, of = work(data, offsets)
                back, back_of = work.decode(ids, of)
                wide = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]
                size = np.diff(offsets)
                same = np.diff(back_of) == size
                if same.all():
                    same = sums_by(back != data, offsets) == 0
                else:
                    same = np.array([s and back[back_of[d] : back_of[d + 1]].tobytes() == data[offsets[d] : offsets[d + 1]].tobytes() for d, s in enumerate(same.tolist())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(of)), pa.array(size), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, restored boolean")
