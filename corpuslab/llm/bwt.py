"""Which windows of a text occur twice, by breadth-first backward extension on its Burrows-Wheeler transform.

The suffixes are sorted by their first `length` symbols only. The transform's backward steps then give the borders
between unequal suffixes for growing common prefixes, all intervals at once: two neighbours in a symbol's interval differ
in d + e symbols if they differ in d, or if a border of e symbols lies between the ranks that d backward steps lead from.
Steps of d symbols are steps of half as many taken twice, so the extension doubles until it has `length` symbols.
Suffixes without a border between them share at least that many.
"""

from __future__ import annotations

import numpy as np

INDEX_BITS = 21
MOST = (1 << INDEX_BITS) - 1


def sort_suffixes(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of text (symbols above 0, one 0 at the end) by their first `length` symbols, equal ones by position.

    Ranks of prefixes double in length; a rank pair and the position fit one word, so each round is a plain sort.
    """
    n = len(text)
    bits = np.uint64(INDEX_BITS)
    index = np.arange(n, dtype=np.uint64)
    low = np.uint64(MOST)

    def ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the order of their keys, the keys in that order); key is overwritten."""
        key <<= bits
        key |= index
        key.sort()
        order = (key & low).astype(np.int32)
        key >>= bits
        return order, key

    key = np.zeros(n, np.uint64)
    have = min(4, length)
    for k in range(have):
        key <<= np.uint64(9)
        key[: n - k] |= text[k:]
    order, key = ordered(key)
    while have < length:
        rank = np.empty(n, np.uint64)
        new = np.zeros(n, np.uint32)
        np.not_equal(key[1:], key[:-1], out=new[1:], casting="unsafe")
        rank[order] = np.cumsum(new, dtype=np.uint32)
        step = min(have, length - have)
        np.left_shift(rank, bits, out=key)
        key[: n - step] |= rank[step:]
        order, key = ordered(key)
        have += step
    return order


def borders(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each rank whether its suffix shares fewer than `length` symbols with the one before."""
    n = len(text)
    last = text[order - 1]  # the symbol before each suffix; the end symbol stands before the first
    back = np.argsort(last, kind="stable").astype(np.int32)  # by rank of a suffix, the rank without its first symbol
    symbol = last[back]
    differ = np.ones(n, bool)  # from the rank above, in one symbol
    np.not_equal(symbol[1:], symbol[:-1], out=differ[1:])

    def extended(differ: np.ndarray, back: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """differ, whose suffixes `back` leads from, with the borders that those of `shorter` give."""
        group = np.cumsum(shorter, dtype=np.int32)[back]
        out = differ.copy()
        out[1:] |= group[1:] != group[:-1]
        return out

    have, done, rest = 1, None, length
    while True:  # length as a sum of powers of two
        if rest & have:
            done = differ if done is None else extended(differ, back, done)
            rest -= have
            if not rest:
                return done
        differ, back, have = extended(differ, back, differ), back[back], 2 * have


def first_windows(pieces: list[bytes], counts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each window of `length` bytes of each piece (counts[i] of them start at its first bytes) whether an equal one stands earlier.

    Pieces stand in the order of their ranks, windows of one piece in the order of their starts. The answers are
    concatenated in the order of the pieces given.
    """
    raw = b"".join(pieces)
    if len(raw) >= MOST:
        raise ValueError(f"{len(raw)} bytes of pieces, {MOST - 1} at most")
    text = np.empty(len(raw) + 1, np.uint16)
    text[:-1] = np.frombuffer(raw, np.uint8)
    text[:-1] += 1
    text[-1] = 0
    order = sort_suffixes(text, length)
    new = borders(text, order, length)
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    total = np.cumsum(counts) - counts
    window = np.full(len(text), -1, np.int64)
    place = np.repeat(begin - total, counts) + np.arange(int(counts.sum()))
    window[place] = np.arange(len(place))
    earlier = np.repeat(rank, counts) * (1 << 40) + np.arange(len(place)) - np.repeat(total, counts)
    group = np.cumsum(new)
    mine = window[order]
    keep = mine >= 0
    mine, group = mine[keep], group[keep]
    if not len(mine):
        return np.zeros(0, bool)
    heads = np.flatnonzero(np.append(True, np.diff(group) != 0))
    least = np.minimum.reduceat(earlier[mine], heads)
    out = np.zeros(len(place), bool)
    out[mine] = earlier[mine] > np.repeat(least, np.diff(np.append(heads, len(mine))))
    return out
