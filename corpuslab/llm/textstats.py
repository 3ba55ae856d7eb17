"""Counts of structure for each whole document of a block."""

from __future__ import annotations

import numpy as np

from .textbatch import Hasher, lower_ascii, mix, runs, sums_by, words

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True  # fixed values of the contract
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether an equal one stands before it."""
    n = len(keys)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n < 2:
        return again, later
    bits = int(n - 1).bit_length()
    low = _U((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=_U))
    order = (packed & low).astype(np.int64)
    same = (packed[1:] & ~low) == (packed[:-1] & ~low)
    if same.any() and (keys[order[1:][same]] != keys[order[:-1][same]]).any():  # the high bits alone don't tell them apart
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


class Structure:
    """Words, their hashes and counts of a block; every array has a number a document unless it says words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n_docs = len(offsets) - 1
        self.starts, self.ends, self.of = words(data, offsets)
        self.hasher = Hasher(data)
        self.word_hash = self.hasher(self.starts, self.ends)
        self.n_words = np.diff(self.of)
        self.doc = np.repeat(np.arange(self.n_docs), self.n_words)
        self.salt = mix(np.arange(1, self.n_docs + 1).astype(_U))
        self.lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.chars = self.lead[offsets[1:]] - self.lead[offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        return sums_by(self.lead[self.ends] - self.lead[self.starts], self.of)

    def of_bytes(self, table: np.ndarray) -> np.ndarray:
        return sums_by(table[self.data], self.offsets)

    def n_symbols(self) -> np.ndarray:
        return self.of_bytes(_SYMBOL)

    def ngram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of n words inside documents, and the first word of each."""
        total = len(self.word_hash) - n + 1
        if total <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        first = np.flatnonzero(self.doc[:total] == self.doc[n - 1 :])
        h = self.word_hash[first]
        for k in range(1, n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + self.word_hash[first + k])
        return h, first

    def repeated_words(self) -> np.ndarray:
        """Of words: in a 3-word window that the text holds twice or more."""
        h, first = self.ngram(3)
        again, _ = repeats(h ^ self.salt[self.doc[first]])
        mark = np.zeros(len(self.word_hash) + 3, bool)
        for k in range(3):
            mark[first[again] + k] = True
        return mark[: len(self.word_hash)]

    def n_repeat_words(self) -> np.ndarray:
        return sums_by(self.repeated_words(), self.of)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines that hold a word, and the document of each."""
        starts, ends = runs(self.data != 0x0A, self.offsets)
        with_word = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[with_word], ends[with_word]
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def n_dup_lines(self) -> np.ndarray:
        starts, ends, doc = self.lines()
        _, later = repeats(self.hasher(starts, ends) ^ self.salt[doc])
        return np.bincount(doc[later], minlength=self.n_docs)

    def ratios(self) -> np.ndarray:
        """Structure statistics of each document, a row of bounded numbers; all 0 for a text without words."""
        n = np.maximum(self.n_words, 1)
        letters = np.maximum(self.word_chars(), 1)
        starts, ends, line_doc = self.lines()
        n_lines = np.maximum(np.bincount(line_doc, minlength=self.n_docs), 1)
        last = self.data[np.maximum(self.ends - 1, 0)] if len(self.ends) else np.zeros(0, np.uint8)
        again, _ = repeats(mix(Hasher(lower_ascii(self.data))(self.starts, self.ends)) ^ self.salt[self.doc])
        single = (self.ends - self.starts) == 1
        twice = np.zeros(len(self.word_hash), bool)
        twice[1:] = (self.word_hash[1:] == self.word_hash[:-1]) & (self.doc[1:] == self.doc[:-1])
        stacked = [
            np.log1p(self.n_words) / 10,
            letters / n / 10,
            self.of_bytes(_UPPER) / letters,
            self.n_symbols() / letters,
            self.of_bytes(_DIGIT) / letters,
            self.n_repeat_words() / n,
            self.n_dup_lines() / n_lines,
            sums_by(_STOP[last], self.of) / n,
            sums_by(again, self.of) / n,
            sums_by(single, self.of) / n,
            sums_by(twice, self.of) / n,
            self.n_words / n_lines / 100,
            np.log1p(n_lines) / 10,
        ]
        return np.minimum(np.stack(stacked, axis=1), 4.0) * (self.n_words > 0)[:, None]
