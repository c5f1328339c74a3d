"""The draws of a resampled list, as ``pick`` makes them of a table."""

from __future__ import annotations

import math

import numpy as np

#: Groups of so many rows at most are resampled as one list.
LISTED = 20_000


def drawn_places(key: int, n: int, replicate: int) -> np.ndarray:
    """The places that replicate ``replicate`` draws, one for each of the ``n`` slots of group ``key``."""
    slot = np.arange(n, dtype=np.int64)
    mixed = (replicate + 1) * (slot + 3) % 10007
    return (104729 * replicate + 7919 * slot + 15485863 * mixed + 31 * key) % n


#: Draws that are made at once.
DRAWN = 1 << 16


def exact_parts(values: np.ndarray) -> list[np.ndarray]:
    """Finite values as sums of few arrays, each of multiples of one unit small enough that up to LISTED of them add up without rounding."""
    parts, left = [], values
    while left.any():
        unit = np.ldexp(1.0, max(int(np.frexp(np.abs(left).max())[1]) - 32, -1074))
        parts.append(np.rint(left / unit) * unit)
        left = left - parts[-1]
    return parts


def drawn_means(key: int, values: np.ndarray, replicates: int) -> list[float]:
    """The mean of each replicate of a list of values, its sum rounded once."""
    n = len(values)
    spread = np.abs(values[values != 0])
    if not np.isfinite(values).all() or (len(spread) and (spread.max() > 1e300 or spread.min() < 1e-250)):
        return [math.fsum(values[drawn_places(key, n, r)].tolist()) / n for r in range(replicates)]
    parts, slot, out = exact_parts(values), np.arange(n, dtype=np.int64), []
    step = max(1, DRAWN // n)
    for first in range(0, replicates, step):
        r = np.arange(first, min(replicates, first + step), dtype=np.int64)[:, None]
        at = (r + 1) * (slot + 3)
        at -= at // 10007 * 10007
        at = 104729 * r + 7919 * slot + 15485863 * at + 31 * key  # as in drawn_places
        at -= at // n * n
        sums = [p[at].sum(1).tolist() for p in parts]
        out += [math.fsum(s) / n for s in zip(*sums, strict=True)] if sums else [0.0] * len(r)
    return out
