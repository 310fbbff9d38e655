"""Plans of windows from a histogram of lengths: least squares over shallow combinations, then best fit for what is left.

A window of 4096 holds seven documents of common length, and no shallow combination of seven lengths can be enumerated. So windows are
nested: full blocks of 64, 128, ... tokens are made first, and a block is a length of its own two sizes up. At every size all combinations of
at most ``depth`` lengths (those above an eighth of the block, and the two smaller kinds of block) that fill it exactly are enumerated,
non-negative least squares finds how often each should be used to use up the histogram (Krell et al., 2021), the counts are rounded down, and
whatever still fits is taken from the most used on. Lengths are exact up to blocks of ``units`` and in classes of size / units above.

What no combination takes is packed by best fit, longest first, over the histogram and not over documents. Everything here works on at most
``window`` lengths and their counts, whatever the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

DEPTH = 3
SOLVER_STEPS = 1000
LEAST_BLOCK = 64
#: A block takes lengths above this part of its size; shorter ones had their chance in smaller blocks.
LEAST_SHARE = 64
#: A window that best fit leaves emptier than this part is given up, and its lengths are left over.
MOST_EMPTY = 100


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of 1 to ``depth`` lengths that sum to ``units``."""

    def of(left: int, most: int, count: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif count:
            for first in range(min(left, most), 0, -1):
                if first * count < left:
                    break
                for rest in of(left - first, first, count - 1):
                    yield (first, *rest)

    return list(of(units, units, depth))


def least_squares(parts: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Counts x >= 0 of the combinations that bring the lengths they use nearest to the histogram, by accelerated projected gradients.

    ``parts`` has a combination's lengths in a row, padded with 0; length 0 is no length.
    """
    lengths = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(parts.ravel(), weights=np.repeat(x, parts.shape[1]), minlength=lengths)
        total[0] = 0
        return total

    # The largest eigenvalue of A'A is at most the largest row sum of A A' (every length's uses times the lengths beside it).
    ones = used(np.ones(len(parts)))
    bound = max(1.0, parts.shape[1] * float(ones.max()))
    x, ahead, pace = np.zeros(len(parts)), np.zeros(len(parts)), 1.0
    for _ in range(steps):
        wrong = used(ahead) - histogram
        wrong[0] = 0
        new = np.maximum(0, ahead - wrong[parts].sum(axis=1) / bound)
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / quicker * (new - x)
        x, pace = new, quicker
    return x


@dataclass(frozen=True)
class Plan:
    """Combinations with their counts."""

    parts: list[tuple[int, ...]]
    counts: list[int]


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> Plan:
    """How often each combination is used; never more rests of a length than there are."""
    all_parts = [p for p in combinations(units, depth) if all(histogram.get(x) for x in p)]
    if not all_parts:
        return Plan([], [])
    padded = np.array([[*p, *[0] * (depth - len(p))] for p in all_parts])
    left = np.zeros(units + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    wanted = np.floor(least_squares(padded, left.astype(float)) + 1e-6).astype(np.int64)
    counts: dict[int, int] = {}
    # Rounded counts first, from the most used; then whatever still fits, from the longest lengths.
    for turn in (wanted, np.full(len(all_parts), np.iinfo(np.int64).max)):
        for k in sorted(np.flatnonzero(turn).tolist(), key=lambda k: (-turn[k], [-x for x in all_parts[k]])):
            part = all_parts[k]
            fits = min(int(left[x]) // part.count(x) for x in set(part))
            take = min(int(turn[k]), fits)
            if take > 0:
                counts[k] = counts.get(k, 0) + take
                for x in part:
                    left[x] -= take
    chosen = sorted(counts)
    return Plan([all_parts[k] for k in chosen], [counts[k] for k in chosen])



#: A run of equal things: what (a length, or minus the size of a block), the first one's number, and how many.
Run = tuple[int, int, int]


@dataclass
class Stock:
    """What is left of every length and kind of block."""

    first: dict[int, int] = field(default_factory=dict)
    count: dict[int, int] = field(default_factory=dict)

    def add(self, what: int, count: int) -> None:
        self.first[what], self.count[what] = 0, count

    def take(self, kinds: list[int], count: int) -> Iterator[Run]:
        """``count`` things of the given kinds, the first kinds first."""
        for what in kinds:
            here = min(count, self.count[what])
            if here:
                yield what, self.first[what], here
                self.first[what] += here
                self.count[what] -= here
                count -= here
            if not count:
                return


@dataclass(frozen=True)
class Placed:
    """A run whose things lie, one each, in consecutive blocks of one size from number ``block`` on, ``at`` tokens from their starts."""

    run: Run
    size: int
    block: int
    at: int


def best_fit(stock: Stock, window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(room left, windows, things) of windows that hold equal lengths; a thing is what and the number of the first window's.

    Longest first, each into the fullest window with room for it; windows with equal room are dealt with together.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    sizes: list[int] = []

    def put(left: int, count: int, things: list[tuple[int, int]]) -> None:
        if left not in room:
            room[left] = []
            insort(sizes, left)
        room[left].append((count, things))

    for what in sorted((k for k, n in stock.count.items() if n), key=lambda k: (-abs(k), k)):
        size, count, first = abs(what), stock.count[what], stock.first[what]
        while count:
            found = bisect_left(sizes, size)
            if found < len(sizes):
                left = sizes[found]
                windows, things = room[left].pop()
                if not room[left]:
                    del room[left], sizes[found]
                fits = min(windows, count)
                if windows > fits:
                    put(left, windows - fits, [(k, n + fits) for k, n in things])
                put(left - size, fits, [*things, (what, first)])
                first, count = first + fits, count - fits
                continue
            each = window // size
            fits, over = divmod(count, each)
            if fits:
                put(window - each * size, fits, [(what, first + i * fits) for i in range(each)])
            if over:
                put(window - over * size, 1, [(what, first + fits * each + i) for i in range(over)])
            count = 0
    for left, windows in room.items():
        for count, things in windows:
            yield left, count, things


@dataclass(frozen=True)
class Layout:
    """Where each length's documents go, by their rank: rows of length, first rank, end rank, first sequence and place, by length and rank.

    The documents of a row lie in consecutive sequences, in the order of place. Ranks without a row are left over.
    """

    rows: np.ndarray
    sequences: int
    #: Documents that combinations took, that best fit took, and that are left over.
    by_squares: int
    by_best_fit: int
    left_over: int


def _from_squares(stock: Stock, window: int, units: int, depth: int) -> tuple[list[Placed], int]:
    """Whole windows, so that long lengths find short ones, then blocks of every size up to the window; and how many windows are filled."""
    placed: list[Placed] = []
    sizes = [window]
    while sizes[-1] % 2 == 0 and sizes[-1] // 2 >= LEAST_BLOCK:
        sizes.append(sizes[-1] // 2)
    filled = 0
    for size in [window, *reversed(sizes)]:
        step = -(-size // units)
        kinds: dict[int, list[int]] = {}
        for what in sorted(stock.count, reverse=True):
            usable = size // LEAST_SHARE < what <= size if what > 0 else -what * 4 >= size
            if usable and stock.count[what]:
                kinds.setdefault(-(-abs(what) // step), []).append(what)
        found = plan({k: sum(stock.count[x] for x in v) for k, v in kinds.items()}, size // step, depth)
        made = filled if size == window else 0
        for lengths, count in zip(found.parts, found.counts, strict=True):
            at = 0
            for length in lengths:
                block = made
                for run in stock.take(kinds[length], count):
                    placed.append(Placed(run, size, block, at))
                    block += run[2]
                at += length * step
            made += count
        if size == window:
            filled = made
        else:
            stock.add(-size, made)
    return placed, filled


def _rows(placed: list[Placed], window: int) -> np.ndarray:
    """Length, first and end rank, first sequence and place of every document's run, through all the blocks that hold it."""
    # Runs of numbers of a kind of block: first, end, first sequence, place of the block there.
    inside: dict[int, list[tuple[int, int, int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    by_size: dict[int, list[Placed]] = {}
    for p in placed:
        by_size.setdefault(p.size, []).append(p)
    for size in sorted(by_size, reverse=True):
        holders = sorted(inside.get(size, []))
        starts = [h[0] for h in holders]
        for p in by_size[size]:
            what, first, count = p.run
            if size == window:
                parts = [(first, first + count, p.block, p.at)]
            else:
                parts = []
                for low, high, sequence, at in holders[max(0, bisect_right(starts, p.block) - 1) : bisect_left(starts, p.block + count)]:
                    a, b = max(low, p.block), min(high, p.block + count)
                    if a < b:
                        parts.append((first + a - p.block, first + b - p.block, sequence + a - low, at + p.at))
            if what > 0:
                rows.extend((what, *part) for part in parts)
            else:
                inside.setdefault(-what, []).extend(parts)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def layout(histogram: dict[int, int], window: int, units: int, depth: int = DEPTH) -> Layout:
    """Places for the documents of a histogram {length: how many}; lengths are 1 to ``window``, which is a power of two times a whole number of units."""
    stock = Stock()
    for length, count in sorted(histogram.items()):
        stock.add(length, count)
    placed, sequences = _from_squares(stock, window, units, depth)
    squared = len(placed)
    for left, windows, things in best_fit(stock, window):
        if left * MOST_EMPTY > window:
            continue
        at = 0
        for what, first in things:
            placed.append(Placed((what, first, windows), window, sequences, at))
            at += abs(what)
        sequences += windows
    rows, own = _rows(placed, window), _rows(placed[:squared], window)
    counted = lambda r: int((r[:, 2] - r[:, 1]).sum())
    return Layout(rows, sequences, counted(own), counted(rows) - counted(own), sum(histogram.values()) - counted(rows))
