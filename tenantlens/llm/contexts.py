"""Cut a sequence into contexts so that equal windows always meet.

Every window of ``size`` units holds a run of ``gram`` units with the smallest
hash, its anchor. Consecutive windows with the anchor at one place form a
context: the units from the first of them to the end of the last. Windows with
equal units have equal anchors at equal offsets, so a window can only repeat
in contexts of the same anchor, once at most in each; and contexts with equal
units need to be looked at once, with a count.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of all runs of a sequence of 64-bit units."""

    _up, _down = _powers(_BASE, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __init__(self, units: np.ndarray):
        n = len(units) + 1
        if n > len(Hashes._up):
            Hashes._up, Hashes._down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(units * Hashes._up[:n - 1], out=self.sums[1:])

    def runs(self, start: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """Hash of units[start : start + length] for each start."""
        h = (self.sums[start + length] - self.sums[start]) * Hashes._down[start]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))

    def all_runs(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * Hashes._down[:n]
        h ^= h >> np.uint64(32)
        h *= _MIX
        return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        a = pick(a[:len(a) - have], a[have:])
        have *= 2
    return pick(a[:len(a) - (width - have)], a[width - have:]) if have < width else a


def contexts(h: Hashes, size: int, gram: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, anchor hash, content hash, start, windows) of every context of several sequences laid end to end.

    Sequence k is units[bounds[k] : bounds[k + 1]]; starts count from its first
    unit. Contexts come in order.
    """
    n = len(h.sums) - 1
    if n < size:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    g = h.all_runs(gram)
    width = size - gram + 1
    order = (g >> np.uint64(32)).astype(np.uint32)  # smallest here, leftmost of equals, is the anchor
    low = _sliding(order, width, np.minimum)  # of each window
    crossing = np.zeros(n + 1, np.int64)
    np.add.at(crossing, np.maximum(bounds[:-1], bounds[1:] - size + 1), 1)
    np.add.at(crossing, bounds[1:], -1)
    low[np.cumsum(crossing)[:len(low)] > 0] = 0  # windows over an end are none and have no anchor
    edge = np.zeros(width - 1, np.uint32)
    place = np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), width, np.maximum) == order)
    value = order[place]
    before = _nearest(place, value, width, -1, np.less_equal)  # the last anchor before that is no larger
    after = _nearest(place, value, width, 1, np.less)  # the first behind that is smaller
    which = np.searchsorted(bounds, place, "right") - 1
    start = np.maximum(np.maximum(place - width, before) + 1, bounds[which])
    windows = np.minimum(np.minimum(place, bounds[which + 1] - size), after - width) - start + 1
    own = np.flatnonzero(windows > 0)
    start, windows, which = start[own], windows[own], which[own]
    return which, g[place[own]], h.runs(start, windows + size - 1), start - bounds[which], windows


def _nearest(place: np.ndarray, value: np.ndarray, reach: int, way: int, beats) -> np.ndarray:
    """Place of the nearest anchor to one side whose value beats the own one; out of reach where there is none."""
    n, far = len(place), np.iinfo(np.int64).max // 2
    out = np.full(n, far * way)
    live, step = np.arange(n), way
    while len(live):
        other = live + step
        inside = (other >= 0) & (other < n)
        live, other = live[inside], other[inside]
        inside = np.abs(place[other] - place[live]) < reach
        live, other = live[inside], other[inside]
        found = beats(value[other], value[live])
        out[live[found]] = place[other[found]]
        live, step = live[~found], step + way
    return out
