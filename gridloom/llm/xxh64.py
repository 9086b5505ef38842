"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: The hash function's fixed primes.
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer ranges go to the library one by one.
_LONG = 2048


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def hash_ranges(buffer: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buffer[start[i]:end[i]] for each i, as uint64."""
    data = buffer + bytes(8)
    words = np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    with np.errstate(over="ignore"):
        h = np.full(len(start), _U(seed) + _P5, dtype=np.uint64)
        at = start.astype(np.int64).copy()
        wide = np.flatnonzero((length >= 32) & (length <= _LONG))
        if len(wide):
            s = _U(seed)
            v = [np.full(len(wide), x, dtype=np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            live, pos = np.arange(len(wide)), at[wide].copy()
            stop = end[wide]
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], words[pos[live] + 8 * k])
                pos[live] += 32
                live = live[pos[live] + 32 <= stop[live]]
            x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for k in range(4):
                x = (x ^ _round(_U(0), v[k])) * _P1 + _P4
            h[wide], at[wide] = x, pos
        h += length.astype(np.uint64)
        live = np.flatnonzero((at + 8 <= end) & (length <= _LONG))
        while len(live):
            h[live] = _rotl(h[live] ^ _round(_U(0), words[at[live]]), 27) * _P1 + _P4
            at[live] += 8
            live = live[at[live] + 8 <= end[live]]
        live = np.flatnonzero((at + 4 <= end) & (length <= _LONG))
        if len(live):
            h[live] = _rotl(h[live] ^ ((words[at[live]] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[live] += 4
        live = np.flatnonzero((at < end) & (length <= _LONG))
        while len(live):
            h[live] = _rotl(h[live] ^ ((words[at[live]] & _U(0xFF)) * _P5), 11) * _P1
            at[live] += 1
            live = live[at[live] < end[live]]
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh64_intdigest(buffer[start[i] : end[i]], seed)
    return h
