"""Nested grouped cross-validation, hyperparameter search, model sweeps, and stored models of every kind.

Folds, inner folds and trials are columns: a linear or nearest-neighbour model is fitted for all of them in one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plotspark.functions.scalars import from_log_target
from plotspark.models import design as ds
from plotspark.models import knn, rff, target, trees
from plotspark.models.gram import LINEAR, Trial, fit_linear, predict_linear
from plotspark.models.registry import MODELS, defaults, draw_params
from plotspark.operators import folds as fd
from plotspark.operators import metrics as mt
from plotspark.session import checkpointed

c = F.col

CUSTOM: dict[str, Callable] = {}


@dataclass(frozen=True)
class Procedure:
    """Everything that defines one run."""

    model: str
    features: Sequence[str]
    target: str = "target"
    params: dict = field(default_factory=dict)
    mode: str = "sequential"
    n_splits: int = 4
    test_size: float = 0.25
    seed: int = 0
    train_aug: bool = True
    score_aug: bool = False
    normalize: Sequence[str] | None = None
    transform: str = "none"  # or "log"
    correction: str = "smearing"

    def all_params(self) -> dict:
        return {**defaults(self.model), **self.params}


@dataclass(frozen=True)
class Run:
    """A finished procedure: predictions of every row under every fold's model, and the fitted parameters."""

    procedure: Procedure
    predictions: DataFrame  # split, filename, plot, aug, is_aug, held_out, fit, actual, predicted
    prep: DataFrame
    fitted: dict[str, DataFrame]  # what the model's kind needs besides prep: coefs, nodes or reference, with cycle and trial
    n_cycles: int
    folds: DataFrame

    @property
    def coefs(self) -> DataFrame | None:
        return self.fitted.get("coefs")


Fitted = dict[str, DataFrame]


def _kernel(proc: Procedure, params: dict, size: int) -> tuple[float, int]:
    """Length scale and number of random features; a length of 0 stands for the plain features."""
    width = int(params.get("features", rff.N_FEATURES))
    if proc.model == "gpr":
        return float(params.get("length_scale", 1.0)), width
    kernel = str(params.get("kernel", "rbf"))
    if kernel == "poly":
        raise ValueError("the polynomial kernel is not supported; use rbf or linear")
    return (rff.svr_length_scale(size), width) if kernel == "rbf" else (0.0, size)


def _spread_wanted(proc: Procedure, params: dict) -> bool:
    return proc.model == "svr" and str(params.get("kernel", "rbf")) == "rbf" and str(params.get("gamma", "scale")) == "scale"


def _fit_predict(rows: DataFrame, proc: Procedure, keys: Sequence[str], n_keys: int, trials: Sequence[Trial]) -> tuple[DataFrame, DataFrame, Fitted]:
    """(design rows with trial and predicted, prep, fitted tables) of one model family."""
    spec = MODELS[proc.model]
    size = len(proc.features)
    prep = ds.fit_prep(rows, proc.features, keys, n_keys, proc.normalize, spec.needs_scaling)
    prepared = ds.design_rows(rows, prep, proc.features, keys, n_keys)
    if proc.model in LINEAR:
        coefs = fit_linear(prepared, prep, keys, size, trials)
        return predict_linear(prepared, coefs, keys, n_keys, len(trials), size), prep, {"coefs": coefs}
    if proc.model in ("gpr", "svr"):
        parts, coef_parts = [], []
        for t in trials:  # the features depend on the trial's length scale
            length, width = _kernel(proc, t.params, size)
            spread = rff.spreads(prepared, keys) if _spread_wanted(proc, t.params) else None
            scaled = rff.divided(prepared, spread, keys, n_keys) if spread is not None else prepared
            lifted = rff.random_features(scaled, size, length, proc.seed, width) if length else scaled
            if proc.model == "gpr":
                coefs = fit_linear(lifted, prep, keys, width, [Trial(t.trial, "gpr", t.params)])
            else:
                coefs = rff.fit_svr(lifted, keys, width, float(t.params.get("C", 10.0)), float(t.params.get("epsilon", 0.1)), int(t.params.get("max_steps", 120))).withColumn("trial", F.lit(t.trial))
                lifted, width = lifted.withColumn("x", F.concat("x", F.array(F.lit(1.0)))), width + 1  # the last weight is the intercept
            parts.append(predict_linear(lifted, coefs, keys, n_keys, 1, width))
            coef_parts.append(coefs.join(spread, list(keys)) if spread is not None else coefs.withColumn("spread", F.lit(1.0)))
        return _union(parts), prep, {"coefs": _union(coef_parts)}
    if proc.model == "knn":
        k_of = {t.trial: max(1, int(t.params.get("n_neighbors", 5))) for t in trials}
        found = knn.nearest(prepared, keys, n_keys, size, max(k_of.values()))
        found = found.persist() if len(trials) > 1 else found
        votes = [knn.vote(found, keys, k_of[t.trial], str(t.params.get("weights", "distance"))).withColumn("trial", F.lit(t.trial)) for t in trials]
        reference = prepared.where("fit").select(*keys, "filename", "y", "x")
        return prepared.join(_union(votes), [*keys, "filename"]), prep, {"reference": reference}
    if list(keys) != ["cycle"]:
        raise ValueError(f"{proc.model!r} is fitted per fold; search it fold by fold")
    parts, nodes = [], []
    for t in trials:
        if proc.model in CUSTOM:
            scored = CUSTOM[proc.model](prepared, prep, size, t.params, n_keys, proc.seed)
        else:
            grown = trees.fit_trees(prepared, proc.model, t.params, proc.seed, size)
            scored = trees.predict_trees(prepared, grown)
            nodes.append(grown.withColumn("trial", F.lit(t.trial)))
        parts.append(scored.withColumn("trial", F.lit(t.trial)))
    return _union(parts), prep, {"nodes": _union(nodes)} if nodes else {}


def _cached(sided: DataFrame) -> DataFrame:
    """Fold rows are read for every statistic; once counted, Spark knows their true size."""
    sided = sided.persist(StorageLevel.MEMORY_AND_DISK)
    sided.count()
    return sided


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scored(rows: DataFrame, proc: Procedure, keys: Sequence[str], n_keys: int, trials: Sequence[Trial]) -> tuple[DataFrame, DataFrame, Fitted]:
    if proc.transform == "log":
        rows = target.to_log(rows)
    scored, prep, fitted = _fit_predict(rows, proc, keys, n_keys, trials)
    if proc.transform == "log":
        fitted = {**fitted, "smears": target.smears(scored, [*keys, "trial"], proc.correction)}
        scored = target.from_log(scored, [*keys, "trial"], n_keys * len(trials), proc.correction)
    return scored, prep, fitted


def run_procedure(df: DataFrame, proc: Procedure, folds: DataFrame | None = None, n_cycles: int | None = None) -> Run:
    """Fit and score the procedure on every outer fold with fixed parameters."""
    rows = ds.labelled_rows(df, proc.features, proc.target)
    if folds is None:
        if proc.mode == "random":
            raise ValueError("random folds overlap; outer folds need a partition mode")
        groups = fd.groups_of(rows)
        n_cycles = min(proc.n_splits, fd.split_cap(groups, proc.test_size))
        folds = fd.grouped_folds(groups, proc.mode, n_cycles, proc.test_size, proc.seed)
    sided = _cached(ds.with_folds(rows, folds, n_cycles, proc.train_aug))
    if not (proc.train_aug and proc.score_aug):
        ds.require_originals(sided, proc.score_aug)
    trial = Trial(0, proc.model, proc.all_params())
    scored, prep, fitted = _scored(sided, proc, ["cycle"], n_cycles, [trial])
    predictions = scored.select(
        (c("cycle") + 1).alias("split"), "filename", "plot", "aug", "is_aug", "held_out", "fit", c("y").alias("actual"), "predicted")
    return Run(proc, predictions, prep, {**fitted, "settings": _settings(df, proc, {k: trial for k in range(n_cycles)})}, n_cycles, folds)


def _settings(df: DataFrame, proc: Procedure, chosen: Mapping[int, Trial]) -> DataFrame:
    """cycle and everything that scoring must know of the procedure besides the fitted tables; one row per fold."""
    rows = [(cycle, proc.model, list(proc.features), json.dumps(t.params, sort_keys=True), proc.seed, proc.transform) for cycle, t in chosen.items()]
    return df.sparkSession.createDataFrame(rows, "cycle int, model string, features array<string>, params string, seed bigint, transform string")


def fold_metrics(run: Run) -> DataFrame:
    """Standard metrics per split: ``held_out`` rows as scored, ``train`` rows as fitted."""
    side = F.when(c("held_out") & (F.lit(run.procedure.score_aug) | ~c("is_aug")), "held_out").when(c("fit"), "train")
    rows = run.predictions.withColumn("scope", side).where(c("scope").isNotNull())
    return mt.standard_metrics(rows, ["split", "scope"])


def fold_cube(run: Run) -> DataFrame:
    return mt.metric_cube(run.predictions, ["split"], c("held_out"), c("is_aug"))


def summary(run: Run) -> DataFrame:
    """One row: mean and spread of the held-out rRMSE over folds, and the best split."""
    held = fold_metrics(run).where(c("scope") == "held_out")
    return held.agg(
        F.lit(run.procedure.model).alias("model"), F.count(F.lit(1)).alias("n_splits"), F.avg("rrmse").alias("mean_rrmse"),
        F.stddev_pop("rrmse").alias("std_rrmse"), mt.lowest("split", "rrmse").alias("best_split"))


# -------------------------------------------------------------------------------------- search
def score_trials(df: DataFrame, proc: Procedure, trials: Sequence[Trial], inner_splits: int = 4, inner_mode: str = "sequential",
                 outer: DataFrame | None = None, n_outer: int = 1, fit_aug: bool = True, score_aug: bool = False) -> DataFrame:
    """(outer, trial, mean_rrmse, mean_r2, mean_r, mean_mape, n_folds) over grouped inner folds.

    With ``outer`` folds the search of every outer fold sees its own training groups only. Inner folds of all outer
    folds, and all trials, are scored in one job.
    """
    rows = ds.labelled_rows(df, proc.features, proc.target)
    rows = rows.withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(n_outer - 1))))
    if outer is not None:  # training groups only
        rows = rows.join(outer.select(c("cycle").alias("outer"), "grp"), ["outer", "grp"], "left_anti")
    groups = rows.select("outer", "grp").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    seed = proc.seed if outer is None else F.lit(proc.seed) + 1000 * (c("outer") + 1)
    inner = fd.folds_per_key(groups, "outer", inner_mode, inner_splits, proc.test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    widest = inner.agg(F.max("cycle")).first()[0] + 1
    counts = inner.groupBy("outer").agg((F.max("cycle") + 1).alias("_cycles"))  # one row per outer fold
    sided = ds.with_folds_per_key(rows.join(counts, "outer"), inner, "outer", fit_aug)
    sided = _cached(sided)
    keys = ["outer", "cycle"]
    if proc.model in LINEAR or proc.model in ("knn", "gpr", "svr"):
        scored, _, _ = _scored(sided, proc, keys, n_outer * widest, trials)
    else:  # fitted fold by fold: renumber (outer, cycle) as one cycle
        flat = sided.withColumn("cycle", c("outer") * widest + c("cycle"))
        scored, _, _ = _scored(flat, proc, ["cycle"], n_outer * widest, trials)
        scored = scored.withColumn("cycle", c("cycle") - c("outer") * widest)
    held = scored.where(c("held_out") & (F.lit(score_aug) | ~c("is_aug")))
    per_fold = mt.standard_metrics(held, ["outer", "trial", "cycle"], "y", "predicted")
    return per_fold.groupBy("outer", "trial").agg(
        F.avg("rrmse").alias("mean_rrmse"), F.avg("r2").alias("mean_r2"), F.avg("r").alias("mean_r"), F.avg("mape").alias("mean_mape"),
        F.count(F.lit(1)).alias("n_folds"))


def best_trials(scores: DataFrame) -> DataFrame:
    """The winner per outer fold: lowest mean rRMSE, first trial on ties; trials without a finite mean never win."""
    winner = mt.lowest(F.struct("trial", "mean_rrmse", "mean_r2", "n_folds"), "mean_rrmse", "trial")
    return scores.groupBy("outer").agg(winner.alias("_b")).where(c("_b").isNotNull()).select("outer", "_b.*")


def draw_trials(proc: Procedure, n_trials: int) -> list[Trial]:
    return [Trial(i, proc.model, draw_params(proc.model, i, proc.seed, len(proc.features), proc.params)) for i in range(n_trials)]


def nested_search(df: DataFrame, proc: Procedure, n_trials: int, inner_splits: int = 4, inner_mode: str = "sequential") -> tuple[Run, DataFrame]:
    """Tune on each outer fold's training groups, refit with the winner, score the untouched block.

    Returns the run and (split, param, value) of the chosen numeric parameters.
    """
    rows = ds.labelled_rows(df, proc.features, proc.target)
    groups = fd.groups_of(rows)
    n_cycles = min(proc.n_splits, fd.split_cap(groups, proc.test_size))
    outer = fd.grouped_folds(groups, proc.mode, n_cycles, proc.test_size, proc.seed).persist()
    trials = draw_trials(proc, n_trials)
    scores = score_trials(df, proc, trials, inner_splits, inner_mode, outer, n_cycles, proc.train_aug, proc.score_aug)
    chosen = {r["outer"]: r["trial"] for r in best_trials(scores).collect()}  # one row per outer fold
    used = sorted(set(chosen.values()))
    sided = _cached(ds.with_folds(rows, outer, n_cycles, proc.train_aug))
    scored, prep, fitted = _scored(sided, proc, ["cycle"], n_cycles, [t for t in trials if t.trial in used])
    pick = F.create_map(*[F.lit(v) for kv in chosen.items() for v in kv])
    scored = scored.where(c("trial") == F.element_at(pick, c("cycle")))
    predictions = scored.select(
        (c("cycle") + 1).alias("split"), "filename", "plot", "aug", "is_aug", "held_out", "fit", c("y").alias("actual"), "predicted")
    fitted = {name: table.where(c("trial") == F.element_at(pick, c("cycle"))) if "trial" in table.columns else table for name, table in fitted.items()}
    fitted["settings"] = _settings(df, proc, {o: trials[t] for o, t in chosen.items()})
    params = [(o + 1, k, float(v)) for o, t in chosen.items() for k, v in trials[t].params.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    fold_params = df.sparkSession.createDataFrame(params, "split int, param string, value double")
    return Run(proc, predictions, prep, fitted, n_cycles, outer), fold_params


# --------------------------------------------------------------------------------------- sweep
def sweep(df: DataFrame, base: Procedure, models: Sequence[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(model, split, scope, metrics) of every model with its defaults, and the models that failed with the reason."""
    from dataclasses import replace

    parts, failed = [], []
    for key in models:
        try:
            run = run_procedure(df, replace(base, model=key, params={**base.params} if key == base.model else {}))
            parts.append(fold_metrics(run).withColumn("model", F.lit(key)))
        except Exception as exc:  # noqa: BLE001 - a model that cannot be fitted must not stop the sweep
            failed.append((key, str(exc).split("\n", 1)[0]))
    if not parts:
        raise ValueError("no model could be fitted: " + "; ".join(f"{k}: {why}" for k, why in failed))
    return _union(parts), failed


def rank_models(metrics: DataFrame) -> DataFrame:
    """Models by mean held-out rRMSE, ties in name order, models without a value last."""
    held, train = (c("scope") == "held_out"), (c("scope") == "train")
    finite = lambda when, name: F.avg(F.when(when & (F.abs(c(name)) < float("inf")), c(name)))
    table = metrics.groupBy("model").agg(
        finite(held, "rrmse").alias("rrmse"), finite(held, "r2").alias("r2"), finite(held, "r").alias("r"),
        finite(held, "mape").alias("mape"), finite(train, "rrmse").alias("train_rrmse"))
    order = Window.orderBy(c("rrmse").asc_nulls_last(), c("model"))  # one row per model
    return table.withColumn("place", F.row_number().over(order))


# ------------------------------------------------------------------------------ stored models
def fitted_table(run: Run) -> DataFrame:
    """A linear model's imputation, scaling and weights, one row per split."""
    if run.coefs is None or run.procedure.model not in LINEAR:
        raise ValueError("only linear models are one table; see stored_tables")
    return run.prep.join(run.coefs.drop("trial"), "cycle").withColumn("split", c("cycle") + 1).drop("cycle")


def linear_score(features: Sequence[str], fitted: Row) -> Column:
    """Prediction of a dataset row under one fold's fitted row."""
    total = F.lit(float(fitted["y_mean"]))
    for i, f in enumerate(features):
        x = (F.coalesce(c(f), F.lit(fitted["med"][i])) - F.lit(fitted["mean"][i])) / F.lit(fitted["scale"][i])
        total = total + F.lit(fitted["w"][i]) * x
    return total


def score_dataset(df: DataFrame, fitted: DataFrame, features: Sequence[str], target_col: str, split: int) -> DataFrame:
    """A stored linear model's predictions on a dataset: filename, grp, plot, aug, actual, predicted."""
    rows = ds.labelled_rows(df, features, target_col)
    one = fitted.where(c("split") == split).first()  # one fold's weights
    if one is None:
        raise ValueError(f"no fitted split {split}")
    return rows.select("filename", "grp", "plot", "aug", c("y").alias("actual"), linear_score(features, one).alias("predicted"))


#: Tables of a stored model, whatever its kind.
MODEL_TABLES = ("settings", "prep", "coefs", "nodes", "reference", "smears")


def stored_tables(run: Run) -> dict[str, DataFrame]:
    """Everything that scoring new rows needs, as tables with split: for the run store, or for ``scorer``."""
    if run.procedure.model in CUSTOM:
        raise ValueError(f"{run.procedure.model!r} has no tables to store")
    tables = {"prep": run.prep, **run.fitted}
    return {name: table.withColumn("split", c("cycle") + 1).drop("cycle", "trial") for name, table in tables.items()}


def scorer(tables: Mapping[str, DataFrame], split: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``predicted`` to rows with the model's features (numbers), by one split of the stored tables of any model."""
    one = lambda name: tables[name].where(c("split") == split)
    setting, prep = one("settings").first(), one("prep").first()
    if setting is None or prep is None:
        raise ValueError(f"no fitted split {split}")
    features, params, model, size = list(setting["features"]), json.loads(setting["params"]), setting["model"], len(setting["features"])
    proc = Procedure(model, features, params=params, seed=setting["seed"])
    x = F.array(*[(F.coalesce(c(f), F.lit(prep["med"][i])) - F.lit(prep["mean"][i])) / F.lit(prep["scale"][i]) for i, f in enumerate(features)])
    smear = one("smears").first()["smear"] if setting["transform"] == "log" else None
    done = (lambda df: df) if smear is None else (lambda df: df.withColumn("predicted", from_log_target(c("predicted"), F.lit(smear))))

    if model in LINEAR or model in ("gpr", "svr"):
        fitted = one("coefs").first()
        weights = F.lit([float(v) for v in fitted["w"]]).cast("array<double>")
        length, width = _kernel(proc, params, size) if model not in LINEAR else (0.0, size)

        def linear(df: DataFrame) -> DataFrame:
            rows = df.withColumn("x", x)
            if model == "svr":
                rows = rows.withColumn("x", F.transform("x", lambda v: v / F.lit(float(fitted["spread"]))))
            if length:
                rows = rff.random_features(rows, size, length, proc.seed, width)
            if model == "svr":
                rows = rows.withColumn("x", F.concat("x", F.array(F.lit(1.0))))
            return done(rows.withColumn("__w", weights).withColumn("predicted", F.lit(float(prep["y_mean"])) + ds.dot("x", "__w", len(fitted["w"]))).drop("x", "__w"))

        return linear
    if model == "knn":
        reference = one("reference").select(F.lit(0).alias("cycle"), "filename", F.lit(True).alias("fit"), "y", "x")

        def neighbours(df: DataFrame) -> DataFrame:
            # Rows are told apart by their own number, so names may repeat and may be those of reference rows.
            numbered = _numbered(df)
            asked = numbered.select(F.lit(0).alias("cycle"), F.concat(F.lit("?"), c("__row").cast("string")).alias("filename"), F.lit(False).alias("fit"), F.lit(0.0).alias("y"), x.alias("x"))
            known = reference.withColumn("filename", F.concat(F.lit("="), c("filename")))
            found = knn.nearest(known.unionByName(asked), ["cycle"], 1, size, max(1, int(params.get("n_neighbors", 5))), only_new=True)
            votes = knn.vote(found, ["cycle"], max(1, int(params.get("n_neighbors", 5))), str(params.get("weights", "distance")))
            votes = votes.select(F.substring("filename", 2, 20).cast("bigint").alias("__row"), "predicted")
            return done(numbered.join(votes, "__row").drop("__row"))

        return neighbours
    nodes = one("nodes").select(F.lit(0).alias("cycle"), *trees.NODE)

    def ensemble(df: DataFrame) -> DataFrame:
        return done(trees.predict_trees(df.withColumns({"cycle": F.lit(0), "x": x}), nodes).drop("cycle", "x"))

    def swapped(df: DataFrame) -> DataFrame:
        given = F.array(*[(F.coalesce(F.get("_given", F.lit(i)), F.lit(prep["med"][i])) - F.lit(prep["mean"][i])) / F.lit(prep["scale"][i]) for i in range(size)])
        found = trees.predict_swapped(df.withColumns({"cycle": F.lit(0), "x": x, "given": given}), nodes, "__each")
        # From an inner explode Spark infers a filter, for which the trees would be asked a second time.
        each = found.select(*df.columns, F.posexplode_outer("__each").alias("__at", "predicted"))
        return done(each.withColumn("feature", F.get(F.array(*[F.lit(f) for f in features]), "__at")).drop("__at"))

    # For importance: every row once for each feature, which is that of the row's ``_given``.
    ensemble.features, ensemble.swapped = features, swapped
    return ensemble


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a number per row, written so that every later look sees the same."""
    return checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))


def score_stored(df: DataFrame, tables: Mapping[str, DataFrame], target_col: str, split: int) -> DataFrame:
    """The predictions of a stored model of any kind on a dataset: filename, grp, plot, aug, actual, predicted."""
    features = list(tables["settings"].where(c("split") == split).first()["features"])
    rows = ds.labelled_rows(df, features, target_col).withColumnRenamed("y", "actual")
    return scorer(tables, split)(rows).select("filename", "grp", "plot", "aug", "actual", "predicted")
