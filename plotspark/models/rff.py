"""Kernel models re-expressed on random Fourier features, which keep them linear in the number of rows.

The Gaussian-process regression is ridge with the noise as penalty; the support-vector regression is an
epsilon-insensitive linear model fitted by Newton steps on a loss rounded off less and less. Kernel parameters are used as given.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.models.design import BROADCAST_BYTES, keyed_join

c = F.col

N_FEATURES = 128


def _uniform(*parts) -> float:
    digest = hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:13], 16) / 2.0 ** 52


def frequencies(size: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded standard normal frequencies (count x size) and phases."""
    normal = [[math.sqrt(-2.0 * math.log(1.0 - _uniform(seed, d, i, "r"))) * math.cos(2.0 * math.pi * _uniform(seed, d, i, "a"))
               for i in range(size)] for d in range(count)]
    phase = [2.0 * math.pi * _uniform(seed, d, "phase") for d in range(count)]
    return np.array(normal), np.array(phase)


def random_features(design: DataFrame, size: int, length_scale: float, seed: int = 0, count: int = N_FEATURES) -> DataFrame:
    """``x`` replaced by sqrt(2/D) cos(w.x / length + phase)."""
    omega, phase = frequencies(size, count, seed)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        return pd.Series(list(math.sqrt(2.0 / count) * np.cos(rows @ omega.T / length_scale + phase)))

    return design.withColumn("x", lift("x"))


def svr_length_scale(size: int) -> float:
    """The length that matches an RBF kernel exp(-d^2 / size) on columns of variance 1."""
    return math.sqrt(size / 2.0)


def spreads(design: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, spread) of all fitted x values of a fold; divided by it, gamma "scale" is 1 / size."""
    whole = lambda f: F.aggregate(F.transform("x", f), F.lit(0.0), lambda a, b: a + b)
    facts = design.where("fit").groupBy(*keys).agg(
        F.sum(whole(lambda v: v)).alias("_s"), F.sum(whole(lambda v: v * v)).alias("_q"), F.sum(F.size("x")).alias("_c"))
    spread = F.sqrt(F.greatest(c("_q") / c("_c") - F.pow(c("_s") / c("_c"), 2), F.lit(0.0)))
    return facts.select(*keys, F.when(spread > 0, spread).otherwise(F.lit(1.0)).alias("spread"))


def divided(design: DataFrame, spread: DataFrame, keys: Sequence[str], n_keys: int) -> DataFrame:
    """``x`` divided by the spread of its fold."""
    rows = keyed_join(design, spread, list(keys), n_keys, 1)
    return rows.withColumn("x", F.transform("x", lambda v: v / c("spread"))).drop("spread")


STEP_SHARES = (1.0, 0.5, 0.25, 0.1, 0.03)
FIRST_WIDTH, LAST_WIDTH, NARROWER = 0.5, 0.002, 0.1
INNER_PASSES = 8


def _losses(miss: np.ndarray, epsilon: float, width: float) -> np.ndarray:
    """The epsilon-insensitive loss, rounded off by a parabola over ``width`` behind epsilon."""
    over = np.maximum(np.abs(miss) - epsilon, 0.0)
    return np.where(over < width, over * over / (2 * width), over - width / 2)


def _curvature(x: np.ndarray, over: np.ndarray, width: float, far: float) -> np.ndarray:
    """Cross-products of the rows behind epsilon, by the curvature of the parabola or ``far`` times that of the secant."""
    bent = over > 0
    weight = np.where(over[bent] < width, 1.0 / width, far / over[bent])
    return (x[bent] * weight[:, None]).T @ x[bent]


@dataclass
class _Fold:
    """A fold's fit on its way: weights (the last one is the intercept), the next step, and the width of the rounding."""

    n: int
    spread: float
    w: np.ndarray
    step: np.ndarray
    width: float
    far: float = 1.0  # how much of their secant curvature rows beyond the parabola count
    passes: int = 0
    settled: bool = False


def fit_svr(design: DataFrame, keys: Sequence[str], size: int, cost: float, epsilon: float, max_steps: int = 120, tol: float = 1e-6) -> DataFrame:
    """(keys, trial, w) of the epsilon-insensitive linear model; w ends with the intercept.

    The loss is rounded off by a parabola whose width shrinks from half the target's spread to 1/500 of it. At every width Newton steps follow
    from the cross-products of the rows behind epsilon; one pass over the rows of all folds gives the losses at several lengths of the last step,
    and slope and curvature at its end. Rows beyond the parabola bend the loss by their secant, the less the better the last steps went. A fold is settled when the slope promises less than ``tol`` of the objective at the last width.
    """
    keys = list(keys)
    rows = design.where("fit").select(*keys, "x", (c("y") - c("y_mean")).alias("_yc"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keys)
    facts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("_yc").alias("s")).collect()  # one row per fold
    wide = size + 1
    state = {tuple(r[k] for k in keys): _Fold(r["n"], r["s"] or 1.0, np.zeros(wide), np.zeros(wide), FIRST_WIDTH * (r["s"] or 1.0)) for r in facts}
    held = max(1, BROADCAST_BYTES // (wide * (wide + 8) * 8))  # folds whose sums one pass brings back
    upper = np.triu_indices(wide)
    shares = len(STEP_SHARES)

    def sums(current: dict) -> dict:
        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict = {}
            for pdf in batches:
                for key, part in pdf.groupby(keys, sort=False):
                    key = key if isinstance(key, tuple) else (key,)
                    if key not in current:
                        continue
                    w, step, width, far = current[key]
                    x = np.column_stack([np.stack(part["x"].to_numpy()), np.ones(len(part))])
                    miss, move = part["_yc"].to_numpy() - x @ w, x @ step
                    losses = [_losses(miss - t * move, epsilon, width).sum() for t in STEP_SHARES]
                    miss = miss - move
                    over = np.maximum(np.abs(miss) - epsilon, 0.0)
                    slope = -(np.sign(miss) * np.minimum(over / width, 1.0)) @ x
                    found[key] = found.get(key, 0.0) + np.concatenate([losses, slope, _curvature(x, over, width, far)[upper]])
            for key, g in found.items():  # one row per fold and partition
                yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "g": [g]})

        partial = rows.mapInPandas(add_up, f"{fields}, g array<double>")
        summed = partial.select(*keys, F.posexplode("g").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        total: dict = {}
        for r in summed.toPandas().itertuples(index=False):  # folds x (features squared), bounded by ``held``
            total.setdefault(tuple(getattr(r, k) for k in keys), np.zeros(shares + wide + len(upper[0])))[r.i] = r.v
        return total

    for _ in range(max_steps):
        waiting = [key for key, fold in state.items() if not fold.settled]
        if not waiting:
            break
        for at in range(0, len(waiting), held):
            few = waiting[at : at + held]
            total = sums({key: (state[key].w, state[key].step, state[key].width, state[key].far) for key in few})
            for key in few:
                _advance(state[key], total[key], cost, tol, upper)
    else:
        if not all(fold.settled for fold in state.values()):
            warnings.warn(f"support vectors: the objective had not settled after {max_steps} steps", RuntimeWarning, stacklevel=2)
    spark = design.sparkSession
    return spark.createDataFrame([(*key, 0, [float(v) for v in fold.w]) for key, fold in state.items()], f"{fields}, trial int, w array<double>")


def _advance(fold: _Fold, total: np.ndarray, cost: float, tol: float, upper: tuple) -> None:
    """Take the best length of the last step, and find the next step where the sums are known."""
    shares, wide = len(STEP_SHARES), len(fold.w)
    ridge = np.append(np.full(wide - 1, 1.0 / (cost * fold.n)), 0.0)  # the intercept is free
    reached = [ridge @ (fold.w + t * fold.step) ** 2 / 2 + loss / fold.n for t, loss in zip(STEP_SHARES, total[:shares], strict=True)]
    best = int(np.argmin(reached))
    fold.w = fold.w + STEP_SHARES[best] * fold.step
    fold.passes += 1
    if fold.step.any():
        fold.far = min(1.0, fold.far * 8) if best else fold.far / 3
        if best:  # slope and curvature were taken at the full step: look again from here
            fold.step = np.zeros(wide)
            return
    slope = ridge * fold.w + total[shares : shares + wide] / fold.n
    curve = np.zeros((wide, wide))
    curve[upper] = total[shares + wide :] / fold.n
    curve = curve + curve.T - np.diag(np.diag(curve)) + np.diag(ridge)
    curve += np.eye(wide) * 1e-10 * max(1e-300, np.trace(curve))
    fold.step = -np.linalg.solve(curve, slope)
    promised = -slope @ fold.step
    objective = max(reached[best], 1e-12 * fold.spread)
    if promised <= tol * objective or fold.passes >= INNER_PASSES:
        last = fold.width <= LAST_WIDTH * fold.spread * (1 + 1e-9)
        if last:
            fold.settled = promised <= 1e3 * tol * objective
            if fold.settled:
                return
        else:
            fold.width = max(fold.width * NARROWER, LAST_WIDTH * fold.spread)
            fold.step = np.zeros(wide)
        fold.passes = 0
