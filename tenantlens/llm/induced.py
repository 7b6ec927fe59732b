"""External suffix sorting by induction, for shards that need not fit in memory.

The order of the S* suffixes (each smaller than its right neighbour and after a
larger one) induces that of all others. Suffixes wait as tuples (position,
common prefix with the one before) in a priority queue by first symbol. The
queue keeps a bounded number of tuples in memory and the rest in a scratch file
of the task, as a sort spills. All tuples with the smallest symbol leave the
queue together and are worked on as arrays.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

MEMORY_ITEMS = 4_000_000  # tuples in memory per queue; texts above this many symbols lie in a file
BASE_ITEMS = 4_000_000  # reduced texts up to this length are sorted in memory
_CHUNK = 1 << 16
_JOIN = 256  # blocks
_FEW = 16


def _width(cap: int):
    """Smallest type for common prefixes, which are counted up to ``cap``."""
    return np.uint8 if cap < 255 else np.uint16 if cap < 65535 else np.int64


class SuffixQueue:
    """Priority queue of (position, common prefix) blocks by symbol, first in first out within a symbol."""

    def __init__(self, memory_items: int, kind, falling: bool = False):
        self.sign, self.kind = -1 if falling else 1, kind
        self.memory_items, self.held, self.blocks, self.heap = memory_items, 0, {}, []
        self.file = None

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if symbol not in self.blocks:
            self.blocks[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        self.blocks[symbol].append((position, prefix))
        self.held += len(position)
        if self.held > self.memory_items:
            self._spill()

    def _spill(self) -> None:
        """Write all blocks in memory to the scratch file; their place and size stay."""
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks.values():
            for k, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    blocks[k] = (self.file.tell(), len(block[0]))
                    self.file.write(block[0].astype("<i8").tobytes() + block[1].astype("<i8").tobytes())
        self.held = 0

    def _load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            self.held -= len(block[0])
            return block
        at, n = block
        self.file.seek(at)
        both = np.frombuffer(self.file.read(16 * n), "<i8").reshape(2, n)
        return both[0], both[1].astype(self.kind)

    def first(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of ``symbol`` joined to larger ones, those pushed meanwhile included."""
        while symbol in self.blocks:
            blocks = self.blocks.pop(symbol)
            self.heap.remove(self.sign * symbol)
            heapq.heapify(self.heap)
            for k in range(0, len(blocks), _JOIN):
                part = [self._load(x) for x in blocks[k:k + _JOIN]]
                yield part[0] if len(part) == 1 else tuple(np.concatenate(x) for x in zip(*part))


def _range_minimum(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of values[left..right], both ends included."""
    span = right - left + 1
    level = (np.frexp(span.astype(np.float64))[1] - 1).astype(np.int8)
    out, table = np.empty(len(left), values.dtype), values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[:len(table) - (1 << k)], table[1 << k:])
    return out


class _Pass:
    """One sweep over the symbols: each suffix met induces the one that begins a symbol earlier, if of the wanted type."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, memory_items: int, falling: bool):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = SuffixQueue(memory_items, _width(cap), falling)
        self.near = np.full(symbols, cap, _width(cap))  # smallest common prefix met since the last suffix pushed, by symbol
        self.fresh = np.ones(symbols, bool)

    def meet(self, position: np.ndarray, prefix: np.ndarray) -> None:
        if len(position) <= _FEW:
            return self._meet_few(position, prefix)
        for a in range(0, len(position), _CHUNK):
            self._meet(position[a:a + _CHUNK], prefix[a:a + _CHUNK])

    def _meet_few(self, position: np.ndarray, prefix: np.ndarray) -> None:
        """As _meet, one by one: long runs of a symbol come in very small blocks."""
        out: dict[int, list] = {}
        for k, at in enumerate(position.tolist()):
            np.minimum(self.near, prefix[k], out=self.near)
            if at and self.wanted[at - 1]:
                symbol = int(self.text[at - 1])
                out.setdefault(symbol, []).append((at - 1, 0 if self.fresh[symbol] else min(int(self.near[symbol]), self.cap - 1) + 1))
                self.near[symbol], self.fresh[symbol] = self.cap, False
        for symbol, items in out.items():
            before, induced = zip(*items)
            self.queue.push(symbol, np.array(before, np.int64), np.array(induced, self.near.dtype))

    def _meet(self, position: np.ndarray, prefix: np.ndarray) -> None:
        before = position - 1
        at = np.flatnonzero((before >= 0) & self.wanted[before])
        symbol = self.text[before[at]]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order].astype(np.int64)
        least = prefix.min()
        if not len(at):
            np.minimum(self.near, least, out=self.near)
            return
        first = np.concatenate(([True], symbol[1:] != symbol[:-1]))
        left = np.where(first, 0, np.concatenate(([0], at[:-1] + 1)))
        low = _range_minimum(prefix, left, at)
        starts = np.flatnonzero(first)
        own = symbol[starts]
        low[starts] = np.minimum(low[starts], self.near[own])
        induced = np.minimum(low, self.cap - 1) + low.dtype.type(1)
        induced[starts[self.fresh[own]]] = 0
        self.fresh[own] = False
        ends = np.append(starts[1:], len(at))
        rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], prefix.dtype.type(self.cap))
        np.minimum(self.near, least, out=self.near)
        self.near[own] = rest[at[ends - 1] + 1]
        for s, a, b in zip(own.tolist(), starts.tolist(), ends.tolist()):
            self.queue.push(s, before[at[a:b]], induced[a:b])


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour's; the last one is."""
    step = np.sign(np.diff(text.astype(np.int64)))
    change = np.flatnonzero(step)
    small = np.ones(len(text), bool)
    small[:-1] = step[change[np.minimum(np.searchsorted(change, np.arange(len(step))), len(change) - 1)]] > 0 if len(change) else True
    return small


def _run_length(text: np.ndarray, at: int, cap: int) -> int:
    piece = text[at:at + cap]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def _induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, prefix: np.ndarray, cap: int, memory_items: int,
            emit: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Emit all suffixes but the last in falling order, each block with the common prefixes to the suffix emitted before."""
    symbols = int(text.max()) + 1
    at_star = text[stars]
    larger, met = _Pass(text, ~small, symbols, cap, memory_items, False), SuffixQueue(memory_items, _width(cap))
    bound = np.flatnonzero(np.concatenate(([True], at_star[1:] != at_star[:-1], [True])))
    nexts = iter([(int(at_star[a]), int(a), int(b)) for a, b in zip(bound, bound[1:])])
    star = next(nexts, None)
    while star is not None or larger.queue.first() is not None:
        symbol = min(s for s in (larger.queue.first(), star[0] if star else None) if s is not None)
        last = None
        for position, common in larger.queue.pop(symbol):
            met.push(symbol, position, common)
            larger.meet(position, common)
            last = int(position[-1])
        if star and star[0] == symbol:
            a, b = star[1:]
            common = prefix[a:b].copy()
            common[0] = 0 if last is None else min(_run_length(text, last, cap), _run_length(text, int(stars[a]), cap))
            larger.meet(stars[a:b], common)
            star = next(nexts, None)
    smaller = _Pass(text, small, symbols, cap, memory_items, True)
    for symbol in sorted(set(np.unique(text).tolist()), reverse=True):
        last = None
        for position, common in smaller.queue.pop(symbol):
            emit(position, common)
            smaller.meet(position, common)
            last = int(position[-1])
        blocks = list(met.pop(symbol))
        if blocks:
            position, common = (np.concatenate([x[k] for x in blocks])[::-1] for k in (0, 1))
            common = np.append(0 if last is None else min(_run_length(text, last, cap), _run_length(text, int(position[0]), cap)), common[:-1]).astype(_width(cap))
            emit(position, common)
            smaller.meet(position, common)


def _common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to ``cap`` of each pair."""
    out, live, step = np.zeros(len(a), np.int32), np.arange(len(a)), np.arange(8)
    end, k = len(text) - 1, 0
    while len(live):
        same = text[np.minimum(a[live, None] + k + step, end)] == text[np.minimum(b[live, None] + k + step, end)]
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[live] += run.astype(np.int32)
        k += 8
        live = live[(run == 8) & (k < cap[live])]
    return np.minimum(out, cap).astype(np.int32)


def _doubled_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a reduced text by ``depth`` names, in memory; ties keep the order of the text."""
    rank, k = names.astype(np.int64), 1
    while k < depth and int(rank.max()) + 1 < len(rank):
        ahead = np.concatenate((rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64)))[:len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1]
        k *= 2
    return np.argsort(rank, kind="stable")


def suffixes(text: np.ndarray, cap: int, emit: Callable[[np.ndarray, np.ndarray], None], *, memory_items: int = MEMORY_ITEMS, base_items: int = BASE_ITEMS) -> None:
    """Emit the suffixes of ``text`` in falling order with their common prefixes, both judged up to ``cap`` symbols.

    ``text`` ends with a symbol smaller than all others. The S* substrings are
    sorted by one induction, their names make a text of at most half the
    length, which is sorted by recursion or, when short, in memory; its order
    induces that of all suffixes.
    """
    small = _types(text)
    star = small.copy()
    star[0] = False
    star[1:] &= ~small[:-1]
    places = np.flatnonzero(star)
    if len(places) < 2:
        stars = places
    else:
        found = []
        in_bucket = places[np.argsort(text[places], kind="stable")]
        _induce(text, small, in_bucket, np.zeros(len(places), np.uint8), 1, memory_items, lambda p, _: found.append(p[star[p]]))
        order = np.append(np.concatenate(found or [places[:0]]), len(text) - 1)[::-1]  # the last suffix is the smallest
        length = np.append(np.diff(places), 0) + 1
        which = np.searchsorted(places, order)
        size = length[which]
        differ = size[1:] != size[:-1]
        alike = np.flatnonzero(~differ)
        differ[alike] = _common_prefix(text, order[alike], order[alike + 1], size[alike]) < size[alike]
        name = np.empty(len(places), np.int64)
        name[which] = np.cumsum(np.concatenate(([False], differ)))
        if name.max() + 1 == len(places):
            rank = which
        elif len(places) <= base_items:
            rank = _doubled_order(name, cap)
        else:
            deeper: list[np.ndarray] = []
            suffixes(name, cap, lambda p, _: deeper.append(p), memory_items=memory_items, base_items=base_items)
            rank = np.append(np.concatenate(deeper), len(name) - 1)[::-1]
        stars = places[rank]
    prefix = np.concatenate((np.zeros(min(1, len(stars)), np.int64), _common_prefix(text, stars[:-1], stars[1:], np.full(max(0, len(stars) - 1), cap)))).astype(_width(cap))
    _induce(text, small, stars, prefix, cap, memory_items, emit)


def repeated_starts(text: np.ndarray, size: int, **limits) -> np.ndarray:
    """Whether the ``size`` symbols from each place start at another place too."""
    out, last = np.zeros(len(text), bool), [None]

    def mark(position: np.ndarray, common: np.ndarray) -> None:
        long = np.flatnonzero(common >= size)
        out[position[long]] = True
        out[position[long[long > 0] - 1]] = True
        if len(long) and long[0] == 0 and last[0] is not None:
            out[last[0]] = True
        last[0] = position[-1]

    suffixes(text, size, mark, **limits)
    return out
