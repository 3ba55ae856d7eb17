"""XXH64 of many byte ranges at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values of the published hash


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of data[starts[i]:ends[i]]; ranges of one length advance together."""
    out = np.empty(len(starts), _U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 5, "<u4", padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable") if lengths.max(initial=0) > 65535 else np.argsort(lengths.astype(np.uint16), kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    seed = _U(seed)
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts) if len(order) else ():
            n, at = int(lengths[rows[0]]), starts[rows]
            i = 0
            if n >= 32:
                acc = [np.full(len(rows), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
                while i + 32 <= n:
                    acc = [_round(a, eight[at + (i + 8 * k)]) for k, a in enumerate(acc)]
                    i += 32
                h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
                for a in acc:
                    h = (h ^ _round(_U(0), a)) * _P1 + _P4
            else:
                h = np.full(len(rows), seed + _P5)
            h = h + _U(n)
            while i + 8 <= n:
                h = _turn(h ^ _round(_U(0), eight[at + i]), 27) * _P1 + _P4
                i += 8
            if i + 4 <= n:
                h = _turn(h ^ (four[at + i].astype(_U) * _P1), 23) * _P2 + _P3
                i += 4
            while i < n:
                h = _turn(h ^ (data[at + i].astype(_U) * _P5), 11) * _P1
                i += 1
            h = (h ^ (h >> _U(33))) * _P2
            h = (h ^ (h >> _U(29))) * _P3
            out[rows] = h ^ (h >> _U(32))
    return out
