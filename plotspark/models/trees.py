"""Histogram tree ensembles for all folds at once, and their nodes as a table.

Every fold's fitting rows are put into quantile bins. Forests draw each row by a Poisson law from the row's digest and the tree's number; boosted
trees follow each other on the residuals. Trees grow level by level: the gain of a cut is the fall of the squared error, with an L2 term on
leaf values, and no cut leaves fewer than the least number of rows on a side. A boosted tree has at most ``MAX_LEAVES`` leaves, and a level's
best gains take what is left of them.

A node of more than ``LOCAL_ROWS`` rows is split by one aggregation over (fold, tree, node, feature, bin) of all such nodes of all folds and
trees; smaller nodes are handed over whole, one bounded group each, and finished in one task (Panda et al., 2009). Boosting goes round by round
the same way, and a fold of no more than ``LOCAL_ROWS`` rows runs all its rounds in one task. Both ways find the same cuts.

The fitted model is a table of nodes; a prediction is the sum of the values of the leaves that a row reaches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.models.design import BROADCAST_BYTES
from plotspark.session import checkpointed

c = F.col

BINS = 255
MAX_LEAVES, BOOSTED_MIN_ROWS = 31, 20  # fixed values of histogram boosting
MAX_DEPTH = 100
#: Rows of a node or fold that one task finishes, and their cells (rows x features, a byte each).
LOCAL_ROWS, LOCAL_CELLS = 500_000, 32_000_000
#: Trees that one task grows from one copy of a fold's rows, and nodes whose histograms one pass holds.
TREES_A_TASK, NODES_A_PASS = 15, 128
#: Rounds of boosting by aggregation after which the residuals are written.
ROUNDS_A_WRITE = 10
#: Nodes that one scoring pass holds, about 30 bytes each.
NODES_A_SCORING = 3_000_000
#: Nodes of so many rows are cut by sums per bin, smaller ones by sorting: at most 4,096 rows at once (12 bits of a number), a bounded number of cells at once.
BINNED_ROWS, ORDERED_ROWS, ORDERED_CELLS = 256, 4096, 32768
#: Leaf values (rows x features x trees) that are held at once where one feature at a time is swapped.
SWAPPED_CELLS = 10_000_000
SUBTREE = 1 << 32
NODE = ["tree", "node", "feature", "threshold", "left", "right", "value"]
ACCURACY = 10_000
NODE_SCHEMA = "cycle int, tree int, node bigint, feature int, threshold double, left bigint, right bigint, value double"
#: Shares of the Poisson law of mean 1: a row is drawn k times where its uniform lies between the k-th and the next.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


@dataclass(frozen=True)
class Law:
    """How the trees of an ensemble grow."""

    model: str
    trees: int
    depth: int
    min_rows: int
    l2: float
    rate: float
    max_leaves: int
    seed: int


def law(model: str, params: dict, seed: int) -> Law:
    depth = int(params.get("max_depth", 0))
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must lie between 0 and {MAX_DEPTH}")
    depth = depth or 1 << 30
    if model == "random_forest":
        return Law(model, int(params.get("n_estimators", 300)), depth, int(params.get("min_samples_leaf", 1)), 0.0, 1.0, 1 << 30, seed)
    if model == "hist_gbt":
        least = int(params.get("min_samples_leaf", BOOSTED_MIN_ROWS))
        return Law(model, int(params.get("max_iter", 200)), depth, least, float(params.get("l2_regularization", 0.0)), float(params.get("learning_rate", 0.1)), MAX_LEAVES, seed)
    raise ValueError(f"{model!r} is not a tree model")


# ------------------------------------------------------------------------------------------ bins
def bin_edges(rows: DataFrame, size: int) -> dict[int, list[np.ndarray]]:
    """cycle -> per feature the cuts between neighbouring quantiles of the fold's fitting rows."""
    shares = F.array(*[F.lit(k / (BINS - 1)) for k in range(BINS)])
    found = rows.groupBy("cycle").agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, F.lit(ACCURACY)).alias(f"q{i}") for i in range(size)]).collect()
    if len(found) * size * BINS * 8 > BROADCAST_BYTES:
        raise ValueError("too many folds and features for one run of trees")
    out = {}
    for r in found:
        values = [np.unique(np.array(r[f"q{i}"], dtype=float)) for i in range(size)]
        out[r["cycle"]] = [(v[1:] + v[:-1]) / 2 for v in values]
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins (features x rows) of a matrix of rows; a value equal to a cut lies below it."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def draws(digests: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row."""
    with np.errstate(over="ignore"):
        z = digests.astype(np.int64).view(np.uint64) + np.uint64(((seed + 1) << 32 | (tree + 1)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right")


# --------------------------------------------------------------------------------------- growing
def _gain(sums: np.ndarray, weights: np.ndarray, whole_sum: np.ndarray, whole_weight: np.ndarray, l2: float) -> np.ndarray:
    """Fall of the squared error by a cut, given what lies below it; in few digits, so that the order of adding up does not choose a cut."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rest_sum, rest = whole_sum - sums, whole_weight - weights
        return (sums * sums / (weights + l2) + rest_sum * rest_sum / (rest + l2) - whole_sum * whole_sum / (whole_weight + l2)).astype(np.float32)


class Nodes:
    """Nodes of a tree as they are found."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for grown, empty in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            grown.extend([empty, empty])
        return at, at + 1


def _allowed(gains: np.ndarray, leaves: int, most: int) -> np.ndarray:
    """Which of a level's nodes are cut: those with a gain, the best first, while leaves are left."""
    order = np.argsort(-gains, kind="stable")
    order = order[gains[order] > 0][: max(0, most - leaves)]
    chosen = np.zeros(len(gains), bool)
    chosen[order] = True
    return chosen


@dataclass
class Level:
    """The rows of a level's open nodes, node after node, and the best cut of every node so far."""

    rows: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    whole_w: np.ndarray
    whole_s: np.ndarray
    top: np.ndarray
    feature: np.ndarray
    cut: np.ndarray

    def part(self, nodes: np.ndarray) -> Level:
        """Some of the nodes, with copies of what they have."""
        sizes = self.sizes[nodes]
        starts = np.cumsum(sizes) - sizes
        rows = self.rows[np.repeat(self.starts[nodes] - starts, sizes) + np.arange(sizes.sum())]
        return Level(rows, starts, sizes, self.whole_w[nodes], self.whole_s[nodes], self.top[nodes], self.feature[nodes], self.cut[nodes])

    def take(self, nodes: np.ndarray, part: Level) -> None:
        self.top[nodes], self.feature[nodes], self.cut[nodes] = part.top, part.feature, part.cut


def _cut_by_bins(bins: np.ndarray, weight: np.ndarray, moment: np.ndarray, unit: bool, level: Level, how: Law) -> None:
    """Best cuts of nodes with many rows: sums per node and bin, one feature at a time."""
    count = len(level.sizes)
    spot = np.repeat(np.arange(count) * 256, level.sizes)
    w, wy = weight[level.rows], moment[level.rows]
    whole_w, whole_s, sizes = level.whole_w[:, None], level.whole_s[:, None], level.sizes[:, None]
    for feature, column in enumerate(bins):
        cell = spot + column[level.rows]
        n = np.bincount(cell, minlength=count * 256).reshape(count, 256)
        run_n = np.cumsum(n, axis=1)
        run_w = run_n if unit else np.cumsum(np.bincount(cell, w, count * 256).reshape(count, 256), axis=1)
        run_s = np.cumsum(np.bincount(cell, wy, count * 256).reshape(count, 256), axis=1)
        gains = _gain(run_s, run_w, whole_s, whole_w, how.l2)
        gains = np.where((n > 0) & (run_n >= how.min_rows) & (sizes - run_n >= how.min_rows), gains, np.float32(0.0))
        cut = gains.argmax(axis=1)
        best = gains[np.arange(count), cut]
        better = best > level.top
        level.top[better], level.feature[better], level.cut[better] = best[better], feature, cut[better]


def _cut_by_order(bins: np.ndarray, weight: np.ndarray, moment: np.ndarray, level: Level, how: Law) -> None:
    """Best cuts of nodes with few rows (``ORDERED_ROWS`` in all): the rows in the order of node and bin, several features at a time."""
    n = len(level.rows)
    spot = np.repeat(np.arange(len(level.sizes)), level.sizes)
    here = np.arange(n)
    # node, bin and place in one number of 32 bits: sorting the numbers sorts the rows
    base = (spot << 20 | here).astype(np.uint32)
    w, wy = weight[level.rows], moment[level.rows]
    whole_w, whole_s = level.whole_w[spot], level.whole_s[spot]
    below = here - level.starts[spot] + 1
    fits = (below >= how.min_rows) & (level.sizes[spot] - below >= how.min_rows)
    step = max(1, ORDERED_CELLS // n)
    for first in range(0, len(bins), step):
        order = base | bins[first : first + step, level.rows].astype(np.uint32) << np.uint32(12)
        order.sort(axis=1)
        place = (order & np.uint32(4095)).astype(np.intp)
        run_w, run_s = np.cumsum(w[place], axis=1), np.cumsum(wy[place], axis=1)
        for run in (run_w, run_s):
            before = run[:, level.starts - 1]
            before[:, 0] = 0.0
            run -= np.repeat(before, level.sizes, axis=1)
        gains = _gain(run_s, run_w, whole_s, whole_w, how.l2)
        cell = order >> np.uint32(12)
        ends = np.empty(cell.shape, bool)
        np.not_equal(cell[:, 1:], cell[:, :-1], out=ends[:, :-1])
        ends[:, -1] = True
        gains[~(ends & fits)] = 0.0
        best = np.maximum.reduceat(gains, level.starts, axis=1)
        feature = best.argmax(axis=0)
        top = best[feature, np.arange(len(feature))]
        better = top > level.top
        if better.any():
            hit = gains[feature[spot], here] == top[spot]
            at = np.minimum.reduceat(np.where(hit, here, n - 1), level.starts)
            cut = cell[feature, at] & np.uint32(255)
            level.top[better], level.feature[better], level.cut[better] = top[better], first + feature[better], cut[better]


def _best_cuts(bins: np.ndarray, weight: np.ndarray, moment: np.ndarray, unit: bool, level: Level, nodes: np.ndarray, how: Law) -> None:
    """The best cut of some nodes of a level: the first feature and the lowest bin of the largest gain."""
    many = level.sizes[nodes] >= BINNED_ROWS
    large, small = nodes[many], nodes[~many]
    for at in range(0, len(large), NODES_A_PASS):
        part = level.part(large[at : at + NODES_A_PASS])
        _cut_by_bins(bins, weight, moment, unit, part, how)
        level.take(large[at : at + NODES_A_PASS], part)
    # as many small nodes at once as ``ORDERED_ROWS`` rows hold
    upto = np.cumsum(level.sizes[small])
    at = 0
    while at < len(small):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ORDERED_ROWS, side="right"))
        part = level.part(small[at:stop])
        _cut_by_order(bins, weight, moment, part, how)
        level.take(small[at:stop], part)
        at = stop


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Law, depth: int = 0) -> tuple[Nodes, np.ndarray]:
    """A tree over rows in memory (bins: features x rows), and the leaf of every row."""
    n = len(y)
    nodes, leaf_of = Nodes(), np.zeros(n, dtype=np.int64)
    moment = weight * y
    square, unit = moment * y, bool((weight == 1).all())
    nodes.value[0] = moment.sum() / (weight.sum() + how.l2) if n else 0.0
    open_ids, leaves = np.array([0]), 1
    rows, sizes = np.arange(n), np.array([n])
    while len(open_ids) and len(rows) and depth < how.depth and leaves < how.max_leaves:
        starts = np.cumsum(sizes) - sizes
        whole_w, whole_s, whole_q = (np.add.reduceat(v[rows], starts) for v in (weight, moment, square))
        level = Level(rows, starts, sizes, whole_w, whole_s, np.zeros(len(sizes), np.float32), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64))
        # Cuts that change nothing but the last digits are none; a node whose whole error is no more than that, or that has too few rows, needs no look.
        least = 1e-7 * (whole_q + 1e-300)
        with np.errstate(divide="ignore", invalid="ignore"):
            left_over = whole_q - whole_s * whole_s / (whole_w + how.l2)
        hopeful = np.flatnonzero((sizes >= 2 * how.min_rows) & ~(left_over < 0.99 * least))
        _best_cuts(bins, weight, moment, unit, level, hopeful, how)
        chosen = _allowed(np.where(level.top > least, level.top, np.float32(0.0)), leaves, how.max_leaves)
        if not chosen.any():
            break
        cut_nodes = np.flatnonzero(chosen)
        fresh = np.array([nodes.split(int(open_ids[k]), int(level.feature[k]), int(level.cut[k])) for k in cut_nodes]).ravel()
        leaves += len(cut_nodes)
        part = level.part(cut_nodes)
        spot = np.repeat(np.arange(len(cut_nodes)), part.sizes)
        side = spot * 2 + (bins[part.feature[spot], part.rows] > part.cut[spot])
        rows = part.rows[np.argsort(side, kind="stable")]
        sizes = np.bincount(side, minlength=len(fresh))
        leaf_of[part.rows] = fresh[side]
        sums, weights = np.bincount(side, moment[part.rows], len(fresh)), np.bincount(side, weight[part.rows], len(fresh))
        for node, value in zip(fresh.tolist(), (sums / (weights + how.l2)).tolist(), strict=True):
            nodes.value[node] = value
        open_ids = fresh
        depth += 1
    return nodes, leaf_of


def _table(nodes: Nodes, edges: list[np.ndarray], cycle: int, tree: int, top: int, scale: float) -> pd.DataFrame:
    """Rows of the node table of a tree, or of the part of one that hangs from the node ``top``."""
    known = lambda values, kind: pd.array([v if f >= 0 else None for f, v in zip(nodes.feature, values, strict=True)], kind)
    cuts = [float(edges[f][b]) if f >= 0 else None for f, b in zip(nodes.feature, nodes.cut, strict=True)]
    first = top * SUBTREE
    return pd.DataFrame({
        "cycle": cycle, "tree": tree, "node": first + np.arange(len(cuts)), "feature": known(nodes.feature, "Int32"), "threshold": pd.array(cuts, "Float64"),
        "left": known([first + v for v in nodes.left], "Int64"), "right": known([first + v for v in nodes.right], "Int64"), "value": np.array(nodes.value) * scale})


def _unpacked(pdf: pd.DataFrame, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), size).T)


def _boosted_here(pdf: pd.DataFrame, edges: list[np.ndarray], how: Law, cycle: int) -> pd.DataFrame:
    """All rounds of a fold whose rows fit a task."""
    pdf = pdf.sort_values("rid", kind="stable")
    bins, y = _unpacked(pdf, len(edges)), pdf["y"].to_numpy()
    base = y.mean()
    now, parts = np.full(len(y), base), []
    for tree in range(how.trees):
        nodes, leaf = grow(bins, y - now, np.ones(len(y)), how)
        now = now + how.rate * np.array(nodes.value)[leaf]
        parts.append(_table(nodes, edges, cycle, tree, 0, how.rate))
    start = Nodes()
    start.value[0] = float(base)
    return pd.concat([_table(start, edges, cycle, -1, 0, 1.0), *parts], ignore_index=True)


# -------------------------------------------------------------------------- large nodes, by histograms
@dataclass
class Top:
    """The upper part of a tree, split by aggregations: plain lists, one place per node."""

    nodes: Nodes
    rows: list[int]
    depth: list[int]
    open: list[int]


def _routed(nodes: Nodes, bins: np.ndarray) -> np.ndarray:
    """The node of a tree that every row stands in."""
    feature, cut, left, right = (np.array(v) for v in (nodes.feature, nodes.cut, nodes.left, nodes.right))
    at = np.zeros(bins.shape[1], dtype=np.int64)
    while True:
        moving = np.flatnonzero(feature[at] >= 0)
        if not len(moving):
            return at
        here = at[moving]
        at[moving] = np.where(bins[feature[here], moving] <= cut[here], left[here], right[here])


def _residual(y: np.ndarray, bins: np.ndarray, base: float, before: Sequence[Nodes], rate: float) -> np.ndarray:
    out = y - base
    for nodes in before:
        out = out - rate * np.array(nodes.value)[_routed(nodes, bins)]
    return out


def _histograms(rows: DataFrame, size: int, wanted: dict, state: dict, how: Law) -> list:
    """The best cut of every wanted node: one aggregation over all rows.

    ``wanted``: (cycle, tree) -> nodes; ``state``: cycle -> (trees so far, the mean, upper trees by number).
    """
    sent = rows.sparkSession.sparkContext.broadcast((wanted, state))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, state = sent.value
        held: dict = {}
        for pdf in batches:
            for cycle, part in pdf.groupby("cycle", sort=False):
                asked = [(tree, nodes) for (k, tree), nodes in wanted.items() if k == cycle]
                if not asked:
                    continue
                before, base, tops = state[cycle]
                bins = _unpacked(part, size)
                y = _residual(part["y"].to_numpy(), bins, base, before, how.rate) if how.model == "hist_gbt" else part["y"].to_numpy()
                for tree, nodes in asked:
                    weight = draws(part["rid"].to_numpy(), tree, how.seed) if how.model == "random_forest" else np.ones(len(part), dtype=np.int64)
                    place = np.full(len(tops[tree].nodes.feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    spot = place[_routed(tops[tree].nodes, bins)]
                    use = (spot >= 0) & (weight > 0)
                    cell = (spot[use] * size + np.arange(size)[:, None]) * 256 + bins[:, use]
                    shape = (len(nodes), size, 256)
                    w, v = np.broadcast_to(weight[use], cell.shape).ravel(), np.broadcast_to((weight * y)[use], cell.shape).ravel()
                    q = np.broadcast_to((weight * y * y)[use], cell.shape).ravel()
                    found = [np.bincount(cell.ravel(), x, np.prod(shape)).reshape(shape) for x in (np.ones(len(w)), w, v, q)]
                    old = held.get((cycle, tree))
                    held[cycle, tree] = found if old is None else [a + b for a, b in zip(old, found, strict=True)]
        for (cycle, tree), (n, w, s, q) in held.items():
            at, feature, cell = np.nonzero(n)
            yield pd.DataFrame({"cycle": cycle, "tree": tree, "node": np.array(wanted[cycle, tree])[at], "feature": feature, "bin": cell, "n": n[at, feature, cell],
                                "w": w[at, feature, cell], "s": s[at, feature, cell], "q": q[at, feature, cell]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:  # features x bins rows
        n, w, s = (np.zeros((size, 256)) for _ in range(3))
        for name, grid in (("n", n), ("w", w), ("s", s)):
            grid[pdf["feature"], pdf["bin"]] = pdf[name]
        run_n, run_w, run_s = (np.cumsum(g, axis=1) for g in (n, w, s))
        rows_here, whole_w, whole_s = run_n[0, -1], run_w[0, -1], run_s[0, -1]
        square = pdf["q"][pdf["feature"] == 0].sum()
        gains = _gain(run_s, run_w, whole_s, whole_w, how.l2)
        gains = np.where((n > 0) & (run_n >= how.min_rows) & (rows_here - run_n >= how.min_rows), gains, np.float32(0.0))
        feature = int(gains.max(axis=1).argmax())
        cut = int(gains[feature].argmax())
        top = float(gains[feature, cut])
        top = top if top > 1e-7 * square else 0.0
        side = lambda a, b: float(a / (b + how.l2)) if b + how.l2 > 0 else 0.0
        key = [pdf[k].iloc[0] for k in ("cycle", "tree", "node")]
        values = [*key, feature, cut, top, int(run_n[feature, cut]), int(rows_here - run_n[feature, cut]), side(run_s[feature, cut], run_w[feature, cut]),
                  side(whole_s - run_s[feature, cut], whole_w - run_w[feature, cut]), side(whole_s, whole_w)]
        return pd.DataFrame([values], columns=["cycle", "tree", "node", "feature", "bin", "gain", "n_low", "n_high", "v_low", "v_high", "v_whole"])

    partial = rows.mapInPandas(count, "cycle int, tree int, node int, feature int, bin int, n double, w double, s double, q double")
    cells = partial.groupBy("cycle", "tree", "node", "feature", "bin").agg(*[F.sum(x).alias(x) for x in ("n", "w", "s", "q")])
    found = cells.groupBy("cycle", "tree", "node").applyInPandas(best, "cycle int, tree int, node int, feature int, bin int, gain double, n_low bigint, n_high bigint, v_low double, v_high double, v_whole double")
    rows_found = found.collect()  # one row per wanted node
    sent.destroy()
    return rows_found


def _passes(todo: dict) -> Iterator[dict]:
    """The nodes to cut in parts that one aggregation holds; a tree with a limit of leaves has all its open nodes in one part."""
    part: dict = {}
    held = 0
    for key, nodes in todo.items():
        for at in range(0, len(nodes), NODES_A_PASS):
            few = nodes[at : at + NODES_A_PASS]
            if held and held + len(few) > NODES_A_PASS or key in part:
                yield part
                part, held = {}, 0
            part[key] = few
            held += len(few)
    if part:
        yield part


def _split_level(rows: DataFrame, size: int, tops: dict, state: dict, how: Law, local: int) -> bool:
    """Cut the open nodes of more than ``local`` rows of all upper trees once; whether there were any."""
    todo: dict = {}
    for key, top in sorted(tops.items()):
        # Nodes that no cut can divide are leaves.
        for node in [n for n in top.open if top.rows[n] > local and (top.depth[n] >= how.depth or top.rows[n] < 2 * how.min_rows)]:
            top.open.remove(node)
        large = [n for n in top.open if top.rows[n] > local]
        if large:
            todo[key] = large
    for wanted in _passes(todo):
        found = {(r["cycle"], r["tree"], r["node"]): r for r in _histograms(rows, size, wanted, state, how)}
        for (cycle, tree), nodes in wanted.items():
            top = tops[cycle, tree]
            cuts = [found.get((cycle, tree, node)) for node in nodes]
            gains = np.array([r["gain"] if r else 0.0 for r in cuts], dtype=np.float32)
            leaves = sum(f < 0 for f in top.nodes.feature)
            for node, r, chosen in zip(nodes, cuts, _allowed(gains, leaves, how.max_leaves), strict=True):
                top.open.remove(node)
                if r and node == 0:
                    top.nodes.value[0] = r["v_whole"]
                if not chosen:
                    continue
                low, high = top.nodes.split(node, r["feature"], r["bin"])
                top.nodes.value[low], top.nodes.value[high] = r["v_low"], r["v_high"]
                top.rows += [r["n_low"], r["n_high"]]
                top.depth += [top.depth[node] + 1] * 2
                top.open += [low, high]
    return bool(todo)


def _root(n: int, value: float) -> Top:
    nodes = Nodes()
    nodes.value[0] = value
    return Top(nodes, [n], [0], [0])


def fit_trees(design: DataFrame, model: str, params: dict, seed: int = 0, size: int | None = None) -> DataFrame:
    """The node table (cycle, tree, node, feature, threshold, left, right, value) of every fold's ensemble."""
    how = law(model, params, seed)
    fit = design.where("fit").select(c("cycle").cast("int").alias("cycle"), F.xxhash64("filename").alias("rid"), c("y").cast("double").alias("y"), "x")
    size = size or len(fit.select("x").first()[0])
    edges = bin_edges(fit, size)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = pd.Series(index=pdf.index, dtype=object)
            for cycle, part in pdf.groupby("cycle", sort=False):
                cells = _binned(np.stack(part["x"].to_numpy()), edges[cycle])
                packed.loc[part.index] = [row.tobytes() for row in cells.T]
            yield pdf.drop(columns="x").assign(bins=packed)

    rows = checkpointed(fit.mapInPandas(binned, "cycle int, rid bigint, y double, bins binary"))
    facts = {r["cycle"]: (r["n"], r["m"]) for r in rows.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m")).collect()}  # one row per fold
    if how.model == "hist_gbt":
        return checkpointed(_boost(rows, facts, edges, how, size))
    return checkpointed(_forest(rows, facts, edges, how, size))


def _local_rows(size: int) -> int:
    """How many rows of so many features one task holds."""
    return max(1, min(LOCAL_ROWS, LOCAL_CELLS // size))


def _forest(rows: DataFrame, facts: dict, edges: dict, how: Law, size: int) -> DataFrame:
    tops = {(cycle, tree): _root(n, 0.0) for cycle, (n, _) in facts.items() for tree in range(how.trees)}
    state = {cycle: ([], 0.0, {tree: tops[cycle, tree] for tree in range(how.trees)}) for cycle in facts}
    while _split_level(rows, size, tops, state, how, _local_rows(size)):
        pass
    tasks = -(-how.trees // TREES_A_TASK)
    sent = rows.sparkSession.sparkContext.broadcast(tops)

    # A fold whose upper trees are single nodes goes to few tasks, each with several trees; others are dealt out by tree and node.
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops = sent.value
        for pdf in batches:
            for cycle, part in pdf.groupby("cycle", sort=False):
                whole = [t for t in range(how.trees) if len(tops[cycle, t].nodes.feature) == 1 and tops[cycle, t].open]
                for first in sorted({t // TREES_A_TASK for t in whole}):
                    yield part.assign(bundle=first, node=-1)
                for tree in sorted(set(range(how.trees)) - set(whole)):
                    top = tops[cycle, tree]
                    at = _routed(top.nodes, _unpacked(part, size))
                    keep = np.isin(at, top.open) & (draws(part["rid"].to_numpy(), tree, how.seed) > 0)
                    if keep.any():
                        yield part[keep].assign(bundle=tasks + tree, node=at[keep])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:  # at most _local_rows(size) rows
        cycle, bundle, at = (int(pdf[k].iloc[0]) for k in ("cycle", "bundle", "node"))
        pdf = pdf.sort_values("rid", kind="stable")
        bins, y, rid = _unpacked(pdf, size), pdf["y"].to_numpy(), pdf["rid"].to_numpy()
        few = range(bundle * TREES_A_TASK, min(how.trees, (bundle + 1) * TREES_A_TASK)) if at < 0 else [bundle - tasks]
        parts = []
        for tree in few:
            weight = draws(rid, tree, how.seed)
            used = weight > 0
            depth = sent.value[cycle, tree].depth[max(at, 0)]
            nodes, _ = grow(bins[:, used], y[used], weight[used].astype(float), how, depth)
            parts.append(_table(nodes, edges[cycle], cycle, tree, max(at, 0), 1.0 / how.trees))
        return pd.concat(parts, ignore_index=True)

    dealt = rows.mapInPandas(deal, "cycle int, rid bigint, y double, bins binary, bundle int, node int")
    # A fixed number of partitions, since few bytes are much work here and would be read by few tasks.
    keys = ["cycle", "bundle", "node"]
    grown = dealt.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, len(facts) * tasks), *keys).groupBy(*keys).applyInPandas(finish, NODE_SCHEMA)
    upper = [_upper_rows(top, edges[cycle], cycle, tree, 1.0 / how.trees) for (cycle, tree), top in sorted(tops.items())]
    return _with_upper(grown, [r for rows_ in upper for r in rows_])


def _upper_rows(top: Top, edges: list[np.ndarray], cycle: int, tree: int, scale: float) -> list[tuple]:
    """Node rows of the upper tree, but the open nodes, which the tasks write."""
    out = []
    nodes = top.nodes
    for k, feature in enumerate(nodes.feature):
        if k in top.open:
            continue
        if feature < 0:
            out.append((cycle, tree, k * SUBTREE, None, None, None, None, nodes.value[k] * scale))
        else:
            out.append((cycle, tree, k * SUBTREE, feature, float(edges[feature][nodes.cut[k]]), nodes.left[k] * SUBTREE, nodes.right[k] * SUBTREE, nodes.value[k] * scale))
    return out


def _with_upper(grown: DataFrame, upper: list[tuple]) -> DataFrame:
    return grown.unionByName(grown.sparkSession.createDataFrame(upper, NODE_SCHEMA)) if upper else grown


def _residuals(rows: DataFrame, sent, size: int, rate: float) -> DataFrame:
    """The rows with what the trees so far leave of ``y``."""
    def less(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        means, before = sent.value
        for pdf in batches:
            y = pdf["y"].to_numpy(copy=True)
            for cycle, at in pdf.groupby("cycle", sort=False).indices.items():
                part = pdf.iloc[at]
                y[at] = _residual(part["y"].to_numpy(), _unpacked(part, size), means[cycle], before[cycle], rate)
            yield pdf.assign(y=y)

    return rows.mapInPandas(less, "cycle int, rid bigint, y double, bins binary")


def _boost(rows: DataFrame, facts: dict, edges: dict, how: Law, size: int) -> DataFrame:
    small = [cycle for cycle, (n, _) in facts.items() if n <= _local_rows(size)]
    here = lambda pdf: _boosted_here(pdf, edges[int(pdf["cycle"].iloc[0])], how, int(pdf["cycle"].iloc[0]))
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, 2 * len(small))
    found = rows.where(c("cycle").isin(small)).repartition(parts, "cycle").groupBy("cycle").applyInPandas(here, NODE_SCHEMA)
    large = {cycle: fact for cycle, fact in facts.items() if cycle not in small}
    before: dict = {cycle: [] for cycle in large}
    upper = [(cycle, -1, 0, None, None, None, None, mean) for cycle, (_, mean) in large.items()]
    means = {cycle: mean for cycle, (_, mean) in large.items()}
    rows = rows.where(~c("cycle").isin(small))
    for tree in range(how.trees if large else 0):
        tops = {(cycle, tree): _root(n, 0.0) for cycle, (n, _) in large.items()}
        state = {cycle: (before[cycle], means[cycle], {tree: tops[cycle, tree]}) for cycle in large}
        while _split_level(rows, size, tops, state, how, 0):
            pass
        for (cycle, _), top in tops.items():
            top.open.clear()
            before[cycle].append(top.nodes)
            upper += _upper_rows(top, edges[cycle], cycle, tree, how.rate)
        if (tree + 1) % ROUNDS_A_WRITE == 0:
            sent = rows.sparkSession.sparkContext.broadcast((means, before))
            rows = checkpointed(_residuals(rows, sent, size, how.rate))
            sent.destroy()
            before, means = {cycle: [] for cycle in large}, dict.fromkeys(large, 0.0)
    return _with_upper(found, upper)


# ---------------------------------------------------------------------------------------- scoring
class Packed:
    """The trees of one fold in arrays, with one entry node per tree; the children of a node lie side by side, a leaf is its own."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], kind="stable").reset_index(drop=True)
        tree, node = nodes["tree"].to_numpy(dtype=np.int64), nodes["node"].to_numpy(dtype=np.int64)
        # The nodes below a top are numbered from 0 without gaps, so a node's place follows from that of its top.
        tops, first = np.unique(tree * (1 << 31) + node // SUBTREE, return_index=True)
        inner = nodes["feature"].notna().to_numpy()
        self.inner = inner
        self.feature = np.where(inner, nodes["feature"].fillna(0), 0).astype(np.int32)
        self.threshold = nodes["threshold"].to_numpy(dtype=float, na_value=np.nan)
        self.value = nodes["value"].to_numpy(dtype=float)
        self.children = np.repeat(np.arange(len(nodes), dtype=np.int32)[:, None], 2, axis=1)
        for k, side in enumerate(("left", "right")):
            child = nodes[side][inner].to_numpy(dtype=np.int64)
            self.children[inner, k] = first[np.searchsorted(tops, tree[inner] * (1 << 31) + child // SUBTREE)] + child % SUBTREE
        self.entries = np.flatnonzero(node == 0)

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum over the trees of the leaf values that the rows of ``x`` reach: tree by tree, whose nodes stay in the processor's cache."""
        rows, size = x.shape
        flat, children = np.ascontiguousarray(x).ravel(), self.children.ravel()
        reached = np.empty((rows, len(self.entries)))
        for k, entry in enumerate(self.entries):
            end = np.full(rows, entry)
            left = np.arange(rows) if self.inner[entry] else np.arange(0)
            at = end
            while len(left):
                high = ~(flat[left * size + self.feature[at]] <= self.threshold[at])
                at = children[at * 2 + high].astype(np.int64)
                more = self.inner[at]
                if not more.all():
                    end[left[~more]] = at[~more]
                    left, at = left[more], at[more]
            reached[:, k] = self.value[end]
        return reached.sum(axis=1)


    def swapped(self, x: np.ndarray, given: np.ndarray) -> np.ndarray:
        """``total`` of every row with one feature at a time taken from ``given``: rows x features.

        Such a row leaves the path of the unchanged one at the first node where the feature's two values part, if there is one; only from there
        on it is followed by itself.
        """
        rows, size = x.shape
        step = max(1, SWAPPED_CELLS // (size * max(1, len(self.entries))))
        return np.concatenate([np.zeros((0, size)), *[self._swapped(x[at : at + step], given[at : at + step]) for at in range(0, rows, step)]])

    def _swapped(self, x: np.ndarray, given: np.ndarray) -> np.ndarray:
        rows, size = x.shape
        own, other, children = np.ascontiguousarray(x).ravel(), np.ascontiguousarray(given).ravel(), self.children.ravel()
        reached = np.empty((rows, size, len(self.entries)))
        none = np.zeros(0, dtype=np.int64)
        for k, entry in enumerate(self.entries):
            end = np.full(rows, entry)
            first = np.arange(rows) * size if self.inner[entry] else none  # of each unchanged row, the cell of its first feature
            at = np.full(len(first), entry)
            parted = np.zeros(rows * size, bool)
            cell, start, spot = none, none, none  # of each row with a swapped feature that is on a way of its own: that feature's cell, the row's first one, the node
            cells, ends = [], []
            while len(first) or len(cell):
                if len(cell):
                    asked = start + self.feature[spot]
                    value = np.where(asked == cell, other[asked], own[asked])
                    spot = children[spot * 2 + ~(value <= self.threshold[spot])].astype(np.int64)
                if len(first):
                    asked, cut = first + self.feature[at], self.threshold[at]
                    high, swapped = ~(own[asked] <= cut), ~(other[asked] <= cut)
                    part = (high != swapped) & ~parted[asked]
                    fresh = asked[part]
                    parted[fresh] = True
                    cell, start = np.concatenate([cell, fresh]), np.concatenate([start, first[part]])
                    spot = np.concatenate([spot, children[at[part] * 2 + swapped[part]].astype(np.int64)])
                    at = children[at * 2 + high].astype(np.int64)
                    more = self.inner[at]
                    if not more.all():
                        end[first[~more] // size] = at[~more]
                        first, at = first[more], at[more]
                more = self.inner[spot]
                if not more.all():
                    cells.append(cell[~more])
                    ends.append(spot[~more])
                    cell, start, spot = cell[more], start[more], spot[more]
            reached[:, :, k] = self.value[end][:, None]
            if cells:
                reached.reshape(rows * size, -1)[np.concatenate(cells), k] = self.value[np.concatenate(ends)]
        return reached.sum(axis=2)


def tree_scorers(nodes: DataFrame) -> Iterator[tuple]:
    """Scoring passes: broadcast {cycle: Packed} of whole trees, about ``NODES_A_SCORING`` nodes each."""
    sizes = sorted(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per tree number, over all folds
    passes: list[list[int]] = [[]]
    held = 0
    for r in sizes:
        if held and held + r["n"] > NODES_A_SCORING:
            passes.append([])
            held = 0
        passes[-1].append(r["tree"])
        held += r["n"]
    for trees in passes:
        table = nodes.where(c("tree").isin(trees)).toArrow().to_pandas()
        yield nodes.sparkSession.sparkContext.broadcast({int(cycle): Packed(part) for cycle, part in table.groupby("cycle")}), len(passes)


def _total(sent) -> Callable[[Column, Column], Column]:
    """What the broadcast trees add to a row's prediction."""

    @F.pandas_udf("double")
    def total(cycle: pd.Series, x: pd.Series) -> pd.Series:
        result = np.full(len(x), np.nan)
        for k, at in cycle.groupby(cycle, sort=False).indices.items():
            packed = sent.value.get(int(k))
            for part in np.array_split(at, -(-len(at) // 4096)) if packed else ():
                result[part] = packed.total(np.stack(x.iloc[part].to_numpy()))
        return pd.Series(result)

    return total


def predict_trees(design: DataFrame, nodes: DataFrame, out: str = "predicted") -> DataFrame:
    """Every row (with cycle and x) with ``predicted`` by its fold's trees; NaN where a fold has none."""
    found = design.withColumn(out, F.lit(0.0))
    for sent, passes in tree_scorers(nodes):
        found = found.withColumn(out, c(out) + _total(sent)("cycle", "x"))
        if passes > 1:  # one pass's trees at a time in the workers' memory
            found = checkpointed(found)
            sent.destroy()
    return found


def _swapped_totals(sent) -> Callable[[Column, Column], Column]:
    """What the broadcast trees add to a row's predictions with one feature at a time taken from another row."""

    @F.pandas_udf("array<double>")
    def totals(cycle: pd.Series, x: pd.Series, given: pd.Series) -> pd.Series:
        result = pd.Series(index=x.index, dtype=object)
        for k, at in cycle.groupby(cycle, sort=False).indices.items():
            packed = sent.value.get(int(k))
            values, others = np.stack(x.iloc[at].to_numpy()), np.stack(given.iloc[at].to_numpy())
            found = packed.swapped(values, others) if packed else np.full(values.shape, np.nan)
            for place, row in zip(at, found, strict=True):
                result.iat[place] = row
        return result

    return totals


def predict_swapped(design: DataFrame, nodes: DataFrame, out: str = "predicted") -> DataFrame:
    """Every row (with cycle, x and given) with ``predicted``: an array of its fold's predictions, in each of which one feature is that of ``given``."""
    found = design.withColumn(out, F.transform("x", lambda _: F.lit(0.0)))
    for sent, passes in tree_scorers(nodes):
        found = found.withColumn(out, F.zip_with(out, _swapped_totals(sent)("cycle", "x", "given"), lambda a, b: a + b))
        if passes > 1:
            found = checkpointed(found)
            sent.destroy()
    return found
