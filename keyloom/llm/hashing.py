"""Hashes of bytes and words, many at a time; apart, so that what needs only these loads numpy alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher: near values become unlike."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


#: A random odd number for the polynomial hash of words, its inverse modulo 2^64, and random values of the bytes.
#: Only anchors depend on these hashes; which windows are equal is decided on their bytes.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
BYTES = mixed(np.arange(256, dtype=_U) + _U(1))


_kept: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; up to two million of them are kept."""
    if n > len(_kept.get(base, "")):
        out = np.full(max(n, 1 << 20), base, _U)
        out[:1] = 1
        out = np.cumprod(out)
        if n > 1 << 21:
            return out[:n]
        _kept[base] = out
    return _kept[base][:n]


def word_hashes(data: bytes, begin: np.ndarray) -> np.ndarray:
    """Of the words between `begin`'s places (less the space after each): a difference of prefix sums, shifted back."""
    h = BYTES[np.frombuffer(data, np.uint8)]
    h *= powers(ODD, len(h))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h)])
    first, last = begin[:-1], begin[1:] - 1
    return mixed((sums[last] - sums[first]) * powers(INVERSE, len(h))[first] + (last - first).astype(_U))


def pieces(data: bytes, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[slice | np.ndarray, np.ndarray]]:
    """Pieces of `data`, eight bytes of all at a time: those that are not at their end, and the bytes as a number, with
    zeros behind the end."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eights = np.ndarray(len(data) + 1, "V8", padded, strides=(1,))  # of numbers, places that are no multiple are slow
    least = int(size.min()) if len(size) else 0
    for j in range(0, int(size.max(initial=0)), 8):
        live = slice(None) if least > j else np.flatnonzero(size > j)
        eight = eights[first[live] + j].view("<u8")
        if least < j + 8:
            over = np.clip(j + 8 - size[live], 0, 7).astype(_U)
            eight &= ~_U(0) >> (over * _U(8))
        yield live, eight
