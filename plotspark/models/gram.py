"""Linear models from cross-products: one pass over the rows for all folds, then tiny solves per fold and trial."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.models.design import dot, keyed_join

c = F.col

# Sweeps stop when no weight moved by more than tol * STRICT of the largest; on cross-products a sweep is cheap, so this is far below tol.
STRICT = 1e-6

LINEAR = ("ridge", "lasso", "elastic_net", "pls")


@dataclass(frozen=True)
class Trial:
    """One model with one parameter choice."""

    trial: int
    model: str
    params: dict = field(default_factory=dict)


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def gram(design: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, i, j, v): sums of products of x, and of x with the centred target (column index ``size``).

    Every partition is reduced to one cross-product per fold before anything is shuffled.
    """
    keys = list(keys)
    rows = design.where("fit").select(*keys, "x", (c("y") - c("y_mean")).alias("_yc"))
    upper = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    ii, jj = np.array([u[0] for u in upper]), np.array([u[1] for u in upper])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False):
                z = np.column_stack([np.stack(part["x"].to_numpy()), part["_yc"].to_numpy()])
                sums[key] = sums.get(key, 0.0) + z.T @ z
        for key, cross in sums.items():  # one triangle per fold and partition
            out = pd.DataFrame({"i": ii, "j": jj, "v": cross[ii, jj]})
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "i", "j", "v"]]

    partial = rows.mapInPandas(products, f"{_key_fields(rows, keys)}, i int, j int, v double")
    return partial.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


# ------------------------------------------------------------------------------ tiny solves (p x p)
def ridge_weights(sxx: np.ndarray, sxy: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.lstsq(sxx + alpha * np.eye(len(sxy)), sxy, rcond=None)[0]


def elastic_net_weights(sxx: np.ndarray, sxy: np.ndarray, n: int, alpha: float, l1: float, max_iter: int = 200000, tol: float = 1e-4) -> np.ndarray:
    """Minimises |r|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2 by cyclic descent on the cross-products."""
    q, b = sxx / n, sxy / n
    w = np.zeros(len(b))
    for _ in range(int(max_iter)):
        largest, change = 0.0, 0.0
        for j in range(len(b)):
            if q[j, j] == 0.0:
                continue
            rho = b[j] - q[j] @ w + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (q[j, j] + alpha * (1.0 - l1))
            change, largest = max(change, abs(new - w[j])), max(largest, abs(new))
            w[j] = new
        if change <= tol * STRICT * max(largest, 1e-300):
            break
    return w


def pls_weights(sxx: np.ndarray, sxy: np.ndarray, n: int, components: int) -> np.ndarray:
    """Partial least squares on unit-variance columns, from cross-products alone."""
    scale = np.sqrt(np.diag(sxx) / max(n - 1, 1))
    scale[scale == 0.0] = 1.0
    a, b = sxx / np.outer(scale, scale), sxy / scale
    rotations: list[np.ndarray] = []
    loadings: list[np.ndarray] = []
    weights = np.zeros(len(b))
    left = b.copy()
    for _ in range(min(components, len(b))):
        norm = np.linalg.norm(left)
        if norm <= 1e-12 * max(np.linalg.norm(b), 1e-300):
            break
        direction = left / norm
        rotation = direction.copy()
        for r, load in zip(rotations, loadings):
            rotation = rotation - (load @ direction) * r
        spread = rotation @ a @ rotation
        if spread <= 0.0:
            break
        load = a @ rotation / spread
        slope = rotation @ b / spread
        left = left - load * slope * spread
        weights = weights + slope * rotation
        rotations.append(rotation)
        loadings.append(load)
    return weights / scale


def weights_of(trial: Trial, sxx: np.ndarray, sxy: np.ndarray, n: int) -> np.ndarray:
    p = trial.params
    if trial.model == "ridge":
        return ridge_weights(sxx, sxy, float(p.get("alpha", 1.0)))
    if trial.model in ("lasso", "elastic_net"):
        l1 = 1.0 if trial.model == "lasso" else float(p.get("l1_ratio", 0.5))
        return elastic_net_weights(sxx, sxy, n, float(p.get("alpha", 1.0)), l1, int(p.get("max_iter", 200000)), float(p.get("tol", 1e-4)))
    if trial.model == "pls":
        return pls_weights(sxx, sxy, n, int(p.get("n_components", 2)))
    if trial.model == "gpr":  # ridge on random features
        return ridge_weights(sxx, sxy, float(p.get("noise_level", 1.0)) + float(p.get("alpha", 1e-6)))
    raise ValueError(f"{trial.model!r} is not a linear model")


def fit_linear(design: DataFrame, prep: DataFrame, keys: Sequence[str], size: int, trials: Sequence[Trial]) -> DataFrame:
    """(keys, trial, w) for every fold and trial from one cross-product pass; every fold and trial is a solve of its own."""
    keys = list(keys)
    chosen = {t.trial: t for t in trials}
    entries = gram(design, keys, size).join(prep.select(*keys, "n_fit"), keys).withColumn("trial", F.explode(F.array(*[F.lit(t).cast("int") for t in chosen])))
    schema = f"{_key_fields(entries, keys)}, trial int, w array<double>"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:  # (size + 1)(size + 2) / 2 rows
        cross = np.zeros((size + 1, size + 1))
        cross[pdf["i"], pdf["j"]] = pdf["v"]
        cross[pdf["j"], pdf["i"]] = pdf["v"]
        n = int(pdf["n_fit"].iloc[0])
        trial = int(pdf["trial"].iloc[0])
        w = weights_of(chosen[trial], cross[:size, :size], cross[:size, size], n).tolist()
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "trial": [trial], "w": [w]}, columns=[*keys, "trial", "w"])

    return entries.groupBy(*keys, "trial").applyInPandas(solve, schema)


def predict_linear(design: DataFrame, coefs: DataFrame, keys: Sequence[str], n_keys: int, n_trials: int, size: int) -> DataFrame:
    """Every design row once per trial with ``predicted``."""
    rows = keyed_join(design, coefs, keys, n_keys * n_trials, size)
    return rows.withColumn("predicted", c("y_mean") + dot("x", "w", size)).drop("w")
