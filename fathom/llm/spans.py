"""Hashes of many spans of a text at once, by prefix sums modulo 2**64.

``rolling`` gives sums over an array of code points, ``hashes`` the hash of each
span [start, end) from them: equal spans have equal hashes wherever they lie.
"""

from __future__ import annotations

import functools

#: Factors, odd.
BASE, MIX, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@functools.cache
def _powers(n: int):
    """Powers of BASE and of its inverse, modulo 2**64."""
    import numpy as np

    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, "u8")
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


def _room(n: int) -> int:
    return max(1 << 19, 1 << int(n).bit_length())


def rolling(codes):
    import numpy as np

    x = (codes.astype("u8") + np.uint64(1)) * np.uint64(MIX)
    x ^= x >> np.uint64(31)
    x *= np.uint64(MIX2)
    sums = np.zeros(len(x) + 1, "u8")
    np.cumsum(x * _powers(_room(len(x)))[0][: len(x)], out=sums[1:])
    return sums


def hashes(sums, starts, ends, kind: int = 0):
    """Spans of different kinds have different hashes."""
    import numpy as np

    h = (sums[ends] - sums[starts]) * _powers(_room(len(sums)))[1][starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(MIX)
    h += np.uint64((kind * MIX2) % (1 << 64))
    return h ^ (h >> np.uint64(29))


def within(starts, sizes):
    """The places of all elements of spans, one span after the other."""
    import numpy as np

    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
