"""Exact k nearest neighbours without comparing everything with everything.

The fitting rows of a fold hang under a tree of two levels: about twice the square root of their number are pivots, some of them head a group of the
others. A row goes to its nearest head and then to that group's nearest pivot; groups and cells have a radius. A query first looks at its own
cell; what it finds there bounds its k-th distance, and only groups and cells that can come nearer are visited: by the triangle inequality, as a
cell's rows lie in a ring about its pivot and its group's head, and as they lie nearer to their own pivot (or head) than to any other.

Neighbouring cells form slabs of at most ``BLOCK_ROWS`` rows. A query is sent once to every slab that it has to visit, with one bit for each of the
slab's cells, never once per cell, since in many dimensions nearly every cell is visited. The queries of a slab are dealt into blocks of about
``BLOCK_ROWS`` too, and so are the rows of a cell that is larger than a slab; every pair of blocks is a group of its own, so neither a crowded cell nor
one that everybody visits is the work of one task. Within a pair, matrix products find the rows that can be among the k nearest, with room for their
rounding, and only those rows' distances are taken from differences. Equal rows are as far from everything, so of each fold's equal rows only the
k first by name take part. Every pair of blocks returns k rows per query at most, none beyond the query's bound, and the ranking keeps k before it
shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotspark.models.design import BROADCAST_BYTES, keyed_join
from plotspark.operators.ranking import hash_sample
from plotspark.session import checkpointed

c = F.col

BLOCK_ROWS = 16_384
#: Distances held at once, and cells looked at for a batch of queries.
PAIRS_AT_ONCE = 1 << 21


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, so that equal rows are at distance 0 exactly."""
    out = np.empty((len(a), len(b)))
    for at in range(0, len(a), 64):
        out[at : at + 64] = np.sqrt(((a[at : at + 64, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


@dataclass
class Cells:
    """The tree of one fold: pivots in order of their group, the groups' heads, and with rows also radii and counts."""

    pivots: np.ndarray
    heads: np.ndarray
    first: np.ndarray  # of every group, and the end
    near: np.ndarray | None = None  # cells x 2: least and greatest distance of a cell's rows to its pivot
    far: np.ndarray | None = None  # cells x 2: and to the group's head
    count: np.ndarray | None = None
    reach: np.ndarray | None = None  # radius of a group
    held: np.ndarray | None = None  # rows of a group
    slab: np.ndarray | None = None  # of every cell, ascending
    slab_first: np.ndarray | None = None  # of every slab, and the end

    @classmethod
    def of(cls, pivots: np.ndarray) -> Cells:
        heads = pivots[: max(1, math.isqrt(len(pivots)))]
        group = _distances(pivots, heads).argmin(axis=1)
        order = np.argsort(group, kind="stable")
        return cls(pivots[order], heads, np.searchsorted(group[order], np.arange(len(heads) + 1)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of every row, and its distances to the cell's pivot and to the group's head."""
        far = _distances(x, self.heads)
        group = far.argmin(axis=1)
        cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            d = _distances(x[at], self.pivots[self.first[g] : self.first[g + 1]])
            cell[at], near[at] = self.first[g] + d.argmin(axis=1), d.min(axis=1)
        return cell, near, far[np.arange(len(x)), group]

    def cut(self, most: int) -> None:
        """Lay neighbouring cells into slabs of at most ``most`` rows; a larger cell is a slab by itself."""
        self.slab, at, held = np.zeros(len(self.count), np.int64), 0, 0
        for cell, n in enumerate(self.count.tolist()):
            if held and held + n > most:
                at, held = at + 1, 0
            self.slab[cell], held = at, held + n
        self.slab_first = np.searchsorted(self.slab, np.arange(at + 2))

    def visits(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
        """Queries x cells: whether the cell is not the own one and can hold one of the k nearest rows of the query."""
        far = _distances(x, self.heads)
        order = np.argsort(far + self.reach, axis=1, kind="stable")
        enough = np.cumsum(self.held[order], axis=1) >= k
        reach = np.take_along_axis(far + self.reach, order, axis=1)[np.arange(len(x)), enough.argmax(axis=1)]
        bound = np.minimum(bound, np.where(enough.any(axis=1), reach, np.inf)) * (1 + 1e-9) + 1e-12
        found = np.zeros((len(x), len(self.pivots)), bool)
        behind = (far - far.min(axis=1, keepdims=True)) / 2
        for g in np.flatnonzero(self.held):
            asked = np.flatnonzero(np.maximum(far[:, g] - self.reach[g], behind[:, g]) - 1e-10 * far[:, g] <= bound)
            if not len(asked):
                continue
            inside = np.arange(self.first[g], self.first[g + 1])
            d, head = _distances(x[asked], self.pivots[inside]), far[asked, g][:, None]
            least = np.maximum.reduce([
                d - self.near[inside, 1], self.near[inside, 0] - d, head - self.far[inside, 1], self.far[inside, 0] - head, (d - d.min(axis=1, keepdims=True)) / 2])
            near = (least - 1e-10 * (d + head) <= bound[asked, None]) & (self.count[inside] > 0)  # the distances' own last digits
            found[asked, self.first[g] : self.first[g + 1]] = near
        found[np.arange(len(x)), own] = False
        return found

    def by_slab(self, visited: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes], np.ndarray]]:
        """For every slab: which queries visit it, their bits for its cells, and how many rows they meet there."""
        for slab in range(len(self.slab_first) - 1):
            inside = slice(self.slab_first[slab], self.slab_first[slab + 1])
            asked = np.flatnonzero(visited[:, inside].any(axis=1))
            if len(asked):
                bits = visited[asked, inside]
                yield slab, asked, [row.tobytes() for row in np.packbits(bits, axis=1)], bits @ self.count[inside]


def _trees(fit: DataFrame, keys: list[str], size: int, most: int) -> dict:
    """Pivots of every fold: about twice the square root of its fitting rows, ``most`` at most."""
    quota = fit.groupBy(*keys).agg(F.least(F.ceil(2 * F.sqrt(F.count(F.lit(1)))), F.lit(most)).cast("bigint").alias("_q"))
    rows = hash_sample(fit.withColumn("_h", F.md5("filename")), keys, "_h", ["filename"], quota, "_q").select(*keys, "filename", "x").collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["filename"]):
        out.setdefault(tuple(r[k] for k in keys), []).append(r["x"])
    return {k: Cells.of(np.array(v, dtype=float).reshape(len(v), size)) for k, v in out.items()}


def _by_fold(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for key, part in pdf.groupby(keys, sort=False):
        yield (key if isinstance(key, tuple) else (key,)), part


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy())


def _best_pairs(asked: np.ndarray, known: np.ndarray, visited: np.ndarray, spots: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of all pairs that can be among a query's k nearest, and perhaps of some more.

    ``known`` is in the order of its cells; ``spots`` says where every cell begins, and the end; ``visited``: queries x cells.
    """
    middle = known.mean(axis=0)
    a, b = asked - middle, known - middle
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = (a2 + b2.max(initial=0.0)) * (a.shape[1] + 16) * 1e-15  # well above what rounding can do to a squared distance
    limit = bound * bound * (1 + 1e-9) + slack
    best = np.full((len(a), k), np.inf)  # squared, as the products give them
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def kept(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, t, d = (np.concatenate(v) for v in zip(*parts, strict=True))
        use = d <= np.minimum(limit, best[:, k - 1] + 2 * slack)[q]
        return q[use], t[use], d[use]

    for cell in np.flatnonzero(np.diff(spots)):
        first, last = int(spots[cell]), int(spots[cell + 1])
        askers = np.flatnonzero(visited[:, cell])
        few = max(1, PAIRS_AT_ONCE // (last - first))
        for at in range(0, len(askers), few):
            q = askers[at : at + few]
            d = a2[q, None] + b2[None, first:last] - 2 * (a[q] @ b[first:last].T)
            best[q] = np.partition(np.concatenate([best[q], d], axis=1), k - 1, axis=1)[:, :k]
            near, t = np.nonzero(d <= np.minimum(limit, best[:, k - 1] + 2 * slack)[q, None])
            held.append((q[near], first + t, d[near, t]))
            rows += len(near)
            if rows > PAIRS_AT_ONCE:
                held = [kept(held)]
                rows = len(held[0][0]) // 2
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, t, _ = kept(held)
    few = max(1, PAIRS_AT_ONCE // max(1, a.shape[1]))
    parts = [np.sqrt(((asked[q[at : at + few]] - known[t[at : at + few]]) ** 2).sum(axis=1)) for at in range(0, len(q), few)]
    return q, t, np.concatenate([np.zeros(0), *parts])


@dataclass
class Search:
    """The prepared cells of some folds; ``compare`` answers queries that name the slabs and cells they visit."""

    keys: list[str]
    fields: str
    size: int
    k: int
    slabs: int
    train: DataFrame  # keys, filename, y, x, slab, spot (the cell's place in its slab)

    def compare(self, asked: DataFrame) -> DataFrame:
        """keys, filename, neighbour, dist, y: for every query (keys, filename, x, slab, bits, bound) the k nearest rows of every block of that slab."""
        keys, slab, k = self.keys, [*self.keys, "slab"], self.k
        blocks = lambda name: F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias(name)
        sizes = self.train.groupBy(*slab).agg(blocks("_blocks")).join(asked.groupBy(*slab).agg(blocks("_parts")), slab)
        deal = lambda n: F.pmod(F.xxhash64("filename"), c(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), c(n) - 1))
        pair = [*slab, "_block", "_part"]
        train = keyed_join(self.train, sizes, slab, self.slabs, 2).withColumn("_block", deal("_blocks")).withColumn("_part", each("_parts"))
        queries = keyed_join(asked, sizes, slab, self.slabs, 2).withColumn("_part", deal("_parts")).withColumn("_block", each("_blocks"))

        def best(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:  # about BLOCK_ROWS rows each
            columns = [*keys, "filename", "neighbour", "dist", "y"]
            if asked.empty or known.empty:
                return pd.DataFrame(columns=columns)
            known = known.sort_values("spot", kind="stable").reset_index(drop=True)
            bits = np.frombuffer(b"".join(asked["bits"]), dtype=np.uint8).reshape(len(asked), -1)
            visited = np.unpackbits(bits, axis=1).astype(bool)
            spots = np.searchsorted(known["spot"].to_numpy(), np.arange(visited.shape[1] + 1))
            bound = asked["bound"].to_numpy(dtype=float, na_value=np.nan)
            q, t, dist = _best_pairs(_matrix(asked["x"]), _matrix(known["x"]), visited, spots, np.where(np.isnan(bound), np.inf, bound), k)
            place = np.empty(len(known), np.int64)
            place[np.argsort(known["filename"].fillna("").to_numpy(dtype=object), kind="stable")] = np.arange(len(known))
            order = np.lexsort((place[t], dist, q))
            q, t, dist = q[order], t[order], dist[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, t = q[keep], t[keep]
            out = pd.DataFrame({"filename": asked["filename"].to_numpy()[q], "neighbour": known["filename"].to_numpy()[t], "dist": dist[keep], "y": known["y"].to_numpy()[t]})
            for name, value in zip(keys, key, strict=False):
                out[name] = value
            return out[columns]

        left = queries.select(*pair, "filename", "x", "bits", "bound").groupBy(*pair)
        right = train.select(*pair, "filename", "y", "x", "spot").groupBy(*pair)
        return left.cogroup(right).applyInPandas(best, f"{self.fields}, filename string, neighbour string, dist double, y double")

    def ranked(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*self.keys, "filename").orderBy("dist", "neighbour"))
        return found.withColumn("rank", rank).where(c("rank") <= self.k)


def _prepared(rows: DataFrame, keys: list[str], n_keys: int, size: int, k: int, only_new: bool) -> tuple[Search, dict, DataFrame]:
    """Cells over the fitting rows, their trees, and the asking rows with the cell they lie in."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    same = Window.partitionBy(*keys, "x").orderBy("filename")
    fit = rows.where("fit").withColumn("_same", F.row_number().over(same)).where(c("_same") <= k).drop("_same")
    fit = checkpointed(fit)
    trees = _trees(fit, keys, size, max(1, BROADCAST_BYTES // max(1, n_keys * size * 16)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in _by_fold(pdf, keys):
                if key in trees:
                    cell, near, far = trees[key].place(_matrix(part["x"]))
                    yield part.assign(cell=cell, near=near, far=far)

    def placed(part: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields)
        return part.mapInPandas(assign, f"{schema}, cell bigint, near double, far double")

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in _by_fold(pdf, keys):
                if key in trees:
                    tree = trees[key]
                    cell, _, _ = tree.place(_matrix(part["x"]))
                    first = tree.slab_first[tree.slab[cell]]
                    width = -(-(tree.slab_first[tree.slab[cell] + 1] - first) // 8)
                    bits = [bytes(s // 8) + bytes([128 >> s % 8]) + bytes(w - s // 8 - 1) for s, w in zip((cell - first).tolist(), width.tolist(), strict=True)]
                    yield part.assign(cell=cell, slab=tree.slab[cell], bits=bits, rows=tree.count[cell])

    train = checkpointed(placed(fit.select(*keys, "filename", "y", "x")))
    cells = checkpointed(train.groupBy(*keys, "cell").agg(*[f(x).alias(f"{x}_{side}") for x in ("near", "far") for side, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n")))
    for tree in trees.values():
        tree.near, tree.far, tree.count = np.zeros((len(tree.pivots), 2)), np.zeros((len(tree.pivots), 2)), np.zeros(len(tree.pivots), np.int64)
        tree.reach, tree.held = np.zeros(len(tree.heads)), np.zeros(len(tree.heads), np.int64)
    for r in cells.collect():  # as many rows as pivots
        tree = trees[tuple(r[q] for q in keys)]
        tree.near[r["cell"]], tree.far[r["cell"]], tree.count[r["cell"]] = (r["near_low"], r["near_high"]), (r["far_low"], r["far_high"]), r["n"]
        group = int(np.searchsorted(tree.first, r["cell"], side="right")) - 1
        tree.reach[group] = max(tree.reach[group], r["far_high"])
        tree.held[group] += r["n"]
    names = []  # as many rows as pivots
    for key, tree in trees.items():
        tree.cut(BLOCK_ROWS)
        names += [(*key, cell, int(tree.slab[cell]), int(cell - tree.slab_first[tree.slab[cell]])) for cell in range(len(tree.pivots))]
    slabs = rows.sparkSession.createDataFrame(names, f"{fields}, cell bigint, slab bigint, spot bigint")
    train = keyed_join(train.drop("near", "far"), slabs, [*keys, "cell"], len(names), 2).drop("cell")
    search = Search(keys, fields, size, k, sum(len(t.slab_first) - 1 for t in trees.values()), train)
    wanted = (rows.where("NOT fit") if only_new else rows).select(*keys, "filename", "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    asked = wanted.mapInPandas(asking, f"{schema}, cell bigint, slab bigint, bits binary, rows bigint")
    return search, trees, asked.withColumn("bound", F.lit(None).cast("double"))


def _visited(search: Search, trees: dict, placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """keys, filename, x, slab, bits, rows, bound: the slabs with further cells that every query has to visit."""
    keys, k = search.keys, search.k
    schema = f"{search.fields}, filename string, x array<double>, slab bigint, bits binary, rows bigint, bound double"

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, part in _by_fold(pdf, keys):
                tree = trees[key]
                few = max(1, PAIRS_AT_ONCE // len(tree.pivots))
                for at in range(0, len(part), few):
                    some = part.iloc[at : at + few]
                    found = tree.visits(_matrix(some["x"]), some["cell"].to_numpy(), some["bound"].fillna(np.inf).to_numpy(dtype=float), k)
                    for slab, asked, bits, rows in tree.by_slab(found):
                        yield some.iloc[asked][[*keys, "filename", "x", "bound"]].assign(slab=slab, bits=bits, rows=rows)

    asked = placed.drop("bound").join(bounds, [*keys, "filename"], "left").select(*keys, "filename", "x", "cell", "bound")
    return asked.mapInPandas(visits, schema)


def nearest(design: DataFrame, keys: Sequence[str], n_keys: int, size: int, k: int, only_new: bool = False) -> DataFrame:
    """(keys, filename, rank, dist, y): the k nearest fitting rows of every design row (or only of those not fitted), ties by file name."""
    return _searched(design, keys, n_keys, size, k, only_new)[0]


def _searched(design: DataFrame, keys: Sequence[str], n_keys: int, size: int, k: int, only_new: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """The neighbours, and for every run of folds all visits."""
    keys = list(keys)
    rows = design.select(*keys, "filename", "fit", "y", "x")
    # Folds of which not even 16 pivots each could be held at once go in several runs.
    runs = -(-n_keys * size * 16 * 16 // BROADCAST_BYTES)
    out, searches = None, []
    for run in range(runs):
        part = rows if runs == 1 else rows.where(F.pmod(F.hash(*keys), F.lit(runs)) == run)
        search, trees, placed = _prepared(part, keys, -(-n_keys // runs), size, k, only_new)
        placed = checkpointed(placed)
        first = checkpointed(search.ranked(search.compare(placed)))
        bounds = first.where(c("rank") == k).select(*keys, "filename", c("dist").alias("bound"))
        asked = checkpointed(_visited(search, trees, placed, bounds))
        found = search.ranked(first.drop("rank").unionByName(search.compare(asked)))
        out = found if out is None else out.unionByName(found)
        searches.append(placed.select(*asked.columns).unionByName(asked))
    return out, searches


def compared_pairs(design: DataFrame, keys: Sequence[str], n_keys: int, size: int, k: int) -> int:
    """How many pairs of rows ``nearest`` compares."""
    return sum(asked.agg(F.sum("rows")).first()[0] or 0 for asked in _searched(design, keys, n_keys, size, k)[1])


def vote(neighbours: DataFrame, keys: Sequence[str], k: int | Column, weights: str) -> DataFrame:
    """(keys, filename, predicted) from ranked neighbours; exact matches take all the weight."""
    used = neighbours.where(c("rank") <= k)
    if weights == "uniform":
        value = F.avg("y")
    else:
        exact = F.count_if(c("dist") == 0)
        inverse = F.when(c("dist") > 0, F.lit(1.0) / c("dist"))
        value = F.when(exact > 0, F.avg(F.when(c("dist") == 0, c("y")))).otherwise(F.try_divide(F.sum(c("y") * inverse), F.sum(inverse)))
    return used.groupBy(*keys, "filename").agg(value.alias("predicted"))
