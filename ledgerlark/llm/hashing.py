"""Hashes of words in byte arrays, a bounded number of bytes at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; what is held besides the text is a multiple of this.
SEGMENT = 1 << 18

_POWERS = np.full(SEGMENT, _BASE, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS)
_BACK = np.full(SEGMENT + 1, pow(_BASE, -1, 1 << 64), np.uint64)
_BACK[0] = 1
_BACK = np.cumprod(_BACK)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A polynomial in each word's bytes, modulo 2 ** 64; values tells what a byte counts.

    Words lie in order and don't overlap; one that is longer than SEGMENT is taken in parts.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + SEGMENT, side="right"))
        if j <= i:
            total, factor = 0, 1
            for at in range(low, int(ends[i]), SEGMENT):
                part = values[data[at : min(at + SEGMENT, int(ends[i]))]]
                total += factor * int((part * _POWERS[: len(part)]).sum(dtype=np.uint64))
                factor = factor * pow(_BASE, SEGMENT, 1 << 64) % (1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        part = values[data[low : int(ends[j - 1])]]
        part *= _POWERS[: len(part)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * _BACK[a]
        i = j
    return out
