"""Rolling hashes of byte windows, vectorised per text (helper of the repeated-window operator)."""

from __future__ import annotations

import numpy as np

# A fixed odd multiplier and a fixed table: hashes must agree between all tasks.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def powers(length: int, sign: int) -> np.ndarray:
    """The first `length` powers of the multiplier (sign 1) or of its inverse (sign -1), modulo 2^64."""
    if len(_powers[sign]) < length:
        size = 1 << (length - 1).bit_length()
        steps = np.full(size, _BASE if sign == 1 else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[sign] = np.cumprod(steps, dtype=np.uint64)
    return _powers[sign][:length]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums S of byte values times falling powers: bytes [i, j) hash to (S[j] - S[i]) * power[i]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data), -1), dtype=np.uint64, out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end)."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), 1)[starts] + (ends - starts).astype(np.uint64))


def window_values(sums: np.ndarray, width: int) -> np.ndarray:
    """Unscrambled hash of the `width` bytes at every start; its high bits order strings at random."""
    count = len(sums) - width
    return (sums[width:] - sums[:count]) * powers(count, 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values
