import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotspark.models import cv, gram, importance, knn, registry, target, trees
from plotspark.models import design as ds
from plotspark.models.gram import Trial

c = F.col


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for plot in range(1, 17):
        base = rng.normal(0, 1, 4)
        y = 300 + 40 * base[0] - 15 * base[1] + rng.normal(0, 1)
        for copy in range(3):
            f = base + (rng.normal(0, 0.05, 4) if copy else 0)
            rows.append((f"field_plot({plot})" + (f"_aug({copy})" if copy else "") + ".laz", *[float(v) for v in f], float(y)))
    return spark.createDataFrame(rows, "filename string, f0 double, f1 double, f2 double, f3 double, target double").persist()


FEATURES = ("f0", "f1", "f2", "f3")


def fold_arrays(data, split, train_aug=True):
    """(x, y) of the fitting rows of a sequential split, and all rows."""
    pdf = data.toPandas()
    pdf["plot"] = pdf["filename"].str.extract(r"plot\((\d+)\)").astype(int)
    held = pdf["plot"].between(4 * split - 3, 4 * split)
    fit = ~held & (train_aug | ~pdf["filename"].str.contains("aug"))
    return pdf, fit, held


def standardised(pdf, fit):
    x = pdf[list(FEATURES)].to_numpy()
    return (x - x[fit].mean(axis=0)) / x[fit].std(axis=0)


def predictions(run, split):
    return run.predictions.where(c("split") == split).select("filename", "predicted").toPandas().set_index("filename")["predicted"]


def test_ridge_matches_normal_equations(data):
    run = cv.run_procedure(data, cv.Procedure("ridge", FEATURES, params={"alpha": 3.0}))
    for split in (1, 4):
        pdf, fit, _ = fold_arrays(data, split)
        x, y = standardised(pdf, fit.to_numpy()), pdf["target"].to_numpy()
        w = np.linalg.solve(x[fit].T @ x[fit] + 3 * np.eye(4), x[fit].T @ (y[fit] - y[fit].mean()))
        got = predictions(run, split).loc[pdf["filename"]].to_numpy()
        assert np.allclose(got, y[fit].mean() + x @ w)


def test_elastic_net_meets_its_optimality_conditions(data):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 5))
    x -= x.mean(axis=0)
    y = x @ [3, 0, -2, 0, 0.1] + rng.normal(0, 0.5, 60)
    y -= y.mean()
    for alpha, l1 in ((0.3, 1.0), (0.3, 0.5), (0.05, 0.9)):
        w = gram.elastic_net_weights(x.T @ x, x.T @ y, 60, alpha, l1)
        slope = x.T @ (y - x @ w) / 60 - alpha * (1 - l1) * w
        assert np.allclose(slope[w != 0], alpha * l1 * np.sign(w[w != 0]), atol=1e-7) and (abs(slope[w == 0]) <= alpha * l1 + 1e-7).all()
    run = cv.run_procedure(data, cv.Procedure("lasso", FEATURES, params={"alpha": 1e6}))
    pdf, fit, _ = fold_arrays(data, 1)
    assert np.allclose(predictions(run, 1), pdf["target"][fit].mean())  # everything shrunk away


def test_pls_with_all_components_is_least_squares():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (50, 4)) * [1, 5, 0.1, 2]
    x -= x.mean(axis=0)
    y = x @ [1, 2, 3, 4] + rng.normal(0, 0.3, 50)
    y -= y.mean()
    w = gram.pls_weights(x.T @ x, x.T @ y, 50, 4)
    assert np.allclose(w, np.linalg.lstsq(x, y, rcond=None)[0])
    one = gram.pls_weights(x.T @ x, x.T @ y, 50, 1)
    s = x.std(axis=0, ddof=1)
    d = (x / s).T @ y
    t = (x / s) @ (d / np.linalg.norm(d))
    assert np.allclose(x @ one, t * (t @ y) / (t @ t))


def test_neighbours_equal_brute_force(data):
    run_rows = ds.labelled_rows(data, FEATURES, "target")
    from plotspark.operators import folds as fd

    folds = fd.sequential_folds(fd.groups_of(run_rows), 4, 0.25)
    sided = ds.with_folds(run_rows, folds, 4)
    prep = ds.fit_prep(sided, FEATURES, ["cycle"], 4)
    rows = ds.design_rows(sided, prep, FEATURES, ["cycle"], 4)
    found = knn.nearest(rows, ["cycle"], 4, 4, 5).toPandas()
    pdf, fit, _ = fold_arrays(data, 2)
    x = standardised(pdf, fit.to_numpy())
    names = pdf["filename"].to_numpy()
    for i in range(0, len(pdf), 5):
        d = np.sqrt(((x[i] - x[fit]) ** 2).sum(axis=1))
        want = sorted(zip(d, names[fit]))[:5]
        got = found[(found["cycle"] == 1) & (found["filename"] == names[i])].sort_values("rank")
        assert list(got["neighbour"]) == [n for _, n in want] and np.allclose(got["dist"], [v for v, _ in want])


def test_neighbour_blocks_split_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 8)
    rows = spark.createDataFrame([(0, f"r{i:03d}", i % 3 != 0, float(i), [1.0, 1.0] if i < 60 else [float(i), 0.0]) for i in range(80)],
                                 "cycle int, filename string, fit boolean, y double, x array<double>")
    found = knn.nearest(rows, ["cycle"], 1, 2, 4).toPandas()
    assert (found.groupby("filename").size() == 4).all() and len(found) == 320
    assert (found[found["filename"] == "r000"].sort_values("rank")["neighbour"].tolist()) == ["r001", "r002", "r004", "r005"]
    votes = knn.vote(spark.createDataFrame(found), ["cycle"], 4, "distance").toPandas().set_index("filename")["predicted"]
    assert votes["r000"] == pytest.approx((1 + 2 + 4 + 5) / 4)


def wide_rows(spark, points, cycles=1, held=lambda i: i % 4 == 0):
    rows = [(k, f"r{i:05d}", not held(i), float(i % 17), [float(v) for v in p]) for k in range(cycles) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "cycle int, filename string, fit boolean, y double, x array<double>").repartition(4)


@pytest.mark.parametrize(("limit", "dims"), [(None, 2), (None, 16), (40_000, 3)])
def test_neighbours_of_any_shape(spark, monkeypatch, limit, dims):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    if limit:  # folds go in several runs
        monkeypatch.setattr(knn, "BROADCAST_BYTES", limit // 40)
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.normal(0, 1, (60, dims)), rng.normal(8, 0.1, (60, dims)), np.zeros((50, dims)), rng.integers(0, 2, (40, dims))])
    found = knn.nearest(wide_rows(spark, points, 3), ["cycle"], 3, dims, 6).toPandas()
    fit = np.arange(len(points)) % 4 != 0
    assert len(found) == 3 * 6 * len(points)
    for (_, name), part in found.groupby(["cycle", "filename"]):
        d = np.sqrt(((points[int(name[1:])] - points) ** 2).sum(axis=1))
        want = sorted((d[i], f"r{i:05d}") for i in np.flatnonzero(fit))[:6]
        assert [(a, b) for a, b in zip(part.sort_values("rank")["dist"], part.sort_values("rank")["neighbour"])] == want


def test_a_query_travels_once_to_a_slab(spark):
    """In many dimensions nearly every cell is visited; a query's row must not be written once per cell."""
    points = np.random.default_rng(5).normal(0, 1, (900, 24))
    _, asked = knn._searched(wide_rows(spark, points), ["cycle"], 1, 24, 7)
    assert sum((a[1] if isinstance(a, tuple) else a).count() for a in asked) <= 2 * len(points)


def test_compared_pairs_grow_slowly(spark):
    rng = np.random.default_rng(3)
    sizes = (1000, 4000)
    pairs = [knn.compared_pairs(wide_rows(spark, rng.normal(0, 1, (n, 3))), ["cycle"], 1, 3, 5) for n in sizes]
    assert math.log(pairs[1] / pairs[0]) / math.log(sizes[1] / sizes[0]) < 1.6 and pairs[1] < 0.1 * sizes[1] ** 2


def test_a_crowd_of_equal_rows_is_compared_by_few(spark):
    points = [[0.0, 0.0]] * 1500 + [[float(i), 1.0] for i in range(60)]
    rows = wide_rows(spark, points)
    assert knn.compared_pairs(rows, ["cycle"], 1, 2, 5) < 60 * len(points)
    found = knn.nearest(rows, ["cycle"], 1, 2, 5).where("filename = 'r01499'").orderBy("rank").collect()
    assert [r["neighbour"] for r in found] == ["r00001", "r00002", "r00003", "r00005", "r00006"]


def test_k_is_clamped_to_the_training_rows(data):
    run = cv.run_procedure(data, cv.Procedure("knn", FEATURES, params={"n_neighbors": 50, "weights": "uniform"}))
    pdf, fit, _ = fold_arrays(data, 1)
    assert np.allclose(predictions(run, 1), pdf["target"][fit].mean())


def test_imputation_and_partial_scaling(data):
    holed = data.withColumn("f2", F.when(c("f2") > 0, c("f2"))).withColumn("f9", F.lit("none"))
    rows = ds.labelled_rows(holed, ("f0", "f2", "f9"), "target")
    from plotspark.operators import folds as fd

    sided = ds.with_folds(rows, fd.sequential_folds(fd.groups_of(rows), 4, 0.25), 4, train_aug=False)
    prep = ds.fit_prep(sided, ("f0", "f2", "f9"), ["cycle"], 4, normalize=["f0", "f9"]).where("cycle = 0").first()
    pdf, fit, _ = fold_arrays(data, 1, train_aug=False)
    f2 = pdf["f2"].where(pdf["f2"] > 0)
    assert prep["med"][1] == pytest.approx(f2[fit].median()) and prep["med"][2] == 0.0
    assert prep["scale"][0] == pytest.approx(pdf["f0"][fit].std(ddof=0)) and prep["scale"][1] == 1.0 and prep["scale"][2] == 1.0
    assert prep["mean"][1] == pytest.approx(f2[fit].fillna(f2[fit].median()).mean())


@pytest.mark.parametrize("model, params", [
    ("random_forest", {"n_estimators": 30}), ("hist_gbt", {"max_iter": 30, "min_samples_leaf": 2}), ("gpr", {"length_scale": 4.0, "noise_level": 0.1}),
    ("svr", {"kernel": "rbf"})])
def test_randomised_models_beat_the_mean_and_repeat(data, model, params):
    proc = cv.Procedure(model, FEATURES, params=params, n_splits=2)
    first = cv.run_procedure(data, proc)
    held = cv.fold_metrics(first).where("scope = 'held_out'").toPandas()
    assert len(held) == 2 and (held["r"] > 0.5).all() and held["r2"].mean() > 0.1
    if model != "svr":  # the same steps would only repeat thirty jobs
        again = cv.run_procedure(data.repartition(5), proc)
        assert np.allclose(predictions(first, 1).sort_index(), predictions(again, 1).sort_index(), rtol=1e-6)


def tree_rows(spark, n=160, cycles=2, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)).round(1)
    y = 3 * (x[:, 0] > 0.3) - 2 * x[:, 1] + rng.normal(0, 0.1, n)
    rows = [(k, f"r{i:04d}", i % (k + 3) != 0, float(y[i]), [float(v) for v in x[i]]) for k in range(cycles) for i in range(n)]
    return spark.createDataFrame(rows, "cycle int, filename string, fit boolean, y double, x array<double>").repartition(3), x, y


def test_a_stump_is_the_best_cut(spark):
    rows, x, y = tree_rows(spark)
    for l2, least in ((0.0, 1), (3.0, 25)):
        nodes = trees.fit_trees(rows, "hist_gbt", {"max_iter": 1, "max_depth": 1, "learning_rate": 1.0, "l2_regularization": l2, "min_samples_leaf": least}).toPandas()
        for k in range(2):
            fit = np.arange(len(y)) % (k + 3) != 0
            r, xs = y[fit] - y[fit].mean(), x[fit]
            best = (0.0, None)
            for f in range(3):
                values = np.unique(xs[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = xs[:, f] <= cut
                    if min(low.sum(), (~low).sum()) >= least:
                        gain = sum(r[side].sum() ** 2 / (side.sum() + l2) for side in (low, ~low))
                        if gain > best[0]:
                            best = (gain, (f, cut, r[low].sum() / (low.sum() + l2), r[~low].sum() / ((~low).sum() + l2)))
            mine = nodes[(nodes["cycle"] == k) & (nodes["tree"] == 0)].set_index("node")
            assert (mine.loc[0, "feature"], pytest.approx(mine.loc[0, "threshold"]), pytest.approx(mine.loc[1, "value"]), pytest.approx(mine.loc[2, "value"])) == best[1]


@pytest.mark.parametrize(("model", "params"), [
    ("random_forest", {"n_estimators": 6, "min_samples_leaf": 3}), ("random_forest", {"n_estimators": 3, "max_depth": 2}),
    ("hist_gbt", {"max_iter": 3, "max_depth": 3, "l2_regularization": 0.5, "min_samples_leaf": 5})])
def test_large_nodes_are_cut_as_small_ones(spark, monkeypatch, model, params):
    rows, x, _ = tree_rows(spark)
    here = trees.predict_trees(rows, trees.fit_trees(rows, model, params, seed=3)).toPandas()
    monkeypatch.setattr(trees, "LOCAL_ROWS", 40)
    monkeypatch.setattr(trees, "NODES_A_PASS", 5)
    monkeypatch.setattr(trees, "NODES_A_SCORING", 30)
    large = trees.fit_trees(rows, model, params, seed=3)
    there = trees.predict_trees(rows, large).toPandas()
    a, b = (d.sort_values(["cycle", "filename"])["predicted"].to_numpy() for d in (here, there))
    assert np.allclose(a, b) and np.std(a) > 0.5
    assert large.groupBy("cycle").agg({"tree": "max"}).count() == 2


def test_forest_draws_follow_the_poisson_law():
    digests = np.random.default_rng(0).integers(-(2**63), 2**63, size=20_000)
    for tree in (0, 7):
        times = trees.draws(digests, tree, 1)
        assert abs(times.mean() - 1) < 0.03 and abs((times == 0).mean() - math.exp(-1)) < 0.01
    assert np.corrcoef(trees.draws(digests, 0, 1), trees.draws(digests, 1, 1))[0, 1] < 0.03


def test_leaves_and_least_rows_are_kept(spark):
    rows, _, _ = tree_rows(spark, 400, 1)
    nodes = trees.fit_trees(rows, "hist_gbt", {"max_iter": 2, "min_samples_leaf": 2}).toPandas()
    leaves = nodes[(nodes["tree"] >= 0) & nodes["feature"].isna()].groupby("tree").size()
    assert (leaves <= trees.MAX_LEAVES).all() and leaves.max() == trees.MAX_LEAVES
    flat = rows.withColumn("y", F.lit(2.5))
    for model in ("random_forest", "hist_gbt"):
        found = trees.predict_trees(flat, trees.fit_trees(flat, model, {"n_estimators": 2, "max_iter": 2})).toPandas()
        assert np.allclose(found["predicted"], 2.5)


def test_unsupported_options_are_errors(data):
    with pytest.raises(ValueError, match="poly"):
        cv.run_procedure(data, cv.Procedure("svr", FEATURES, params={"kernel": "poly"}))
    with pytest.raises(ValueError, match="max_depth"):
        cv.run_procedure(data, cv.Procedure("random_forest", FEATURES, params={"max_depth": 101}))
    with pytest.raises(ValueError, match="random"):
        cv.run_procedure(data, cv.Procedure("ridge", FEATURES, mode="random"))
    with pytest.raises(ValueError, match="original"):
        cv.run_procedure(data.where(c("filename").contains("aug")), cv.Procedure("ridge", FEATURES))


def test_smearing_removes_bias(spark):
    rng = np.random.default_rng(0)
    res = rng.normal(0, 0.5, 20000)
    df = spark.createDataFrame([(float(v),) for v in res] + [(float("inf"),), (float("nan"),)], "r double")
    assert df.agg(target.smearing(c("r"))).first()[0] == pytest.approx(math.exp(0.125), rel=0.02)
    assert df.where("false").agg(target.smearing(c("r"))).first()[0] == 1.0


def test_log_target(data, spark):
    from plotspark.functions.scalars import from_log_target, log_target

    ys = spark.createDataFrame([(v,) for v in (0.0, 0.5, 3.0, 120.0)], "y double")
    assert all(abs(r["y"] - r["b"]) < 1e-9 for r in ys.withColumn("b", from_log_target(log_target(c("y")))).collect())
    with pytest.raises(ValueError, match="1 row"):
        target.to_log(spark.createDataFrame([(-2.0,), (1.0,)], "y double"))
    plain = cv.summary(cv.run_procedure(data, cv.Procedure("ridge", FEATURES, transform="log"))).first()
    naive = cv.run_procedure(data, cv.Procedure("ridge", FEATURES, transform="log", correction="naive"))
    assert plain["mean_rrmse"] < 10 and naive.predictions.where("predicted < 0").count() == 0


def test_nested_run_shapes(data):
    run = cv.run_procedure(data, cv.Procedure("ridge", FEATURES, mode="systematic", score_aug=True))
    assert run.predictions.count() == 48 * 4
    held = run.predictions.where("held_out")
    assert held.count() == 48 and held.select("filename").distinct().count() == 48  # everything held out exactly once
    cube = cv.fold_cube(run)
    assert cube.count() == 4 * 8 and cube.where("scope = 'overall' and variant = 'aug_aug' and n <> 48").count() == 0
    assert cube.where("scope = 'train' and variant = 'orig_only' and n <> 12").count() == 0
    row = cv.summary(run).first()
    best = cv.fold_metrics(run).where("scope = 'held_out'").orderBy("rrmse").first()
    assert row["best_split"] == best["split"] and row["n_splits"] == 4


def test_search_finds_the_better_penalty(data):
    proc = cv.Procedure("ridge", FEATURES)
    trials = [Trial(0, "ridge", {"alpha": 1e4}), Trial(1, "ridge", {"alpha": 0.1})]
    scores = cv.score_trials(data, proc, trials, 3)
    assert cv.best_trials(scores).first()["trial"] == 1
    run, params = cv.nested_search(data, proc, 4, 3)
    assert params.select("split").distinct().count() == 4 and cv.fold_metrics(run).count() == 8


def test_search_space(spark):
    rows = {(r["model"], r["param"]): r for r in registry.search_space(spark, 3).collect()}
    assert rows[("ridge", "alpha")]["log_scale"] and not rows[("knn", "n_neighbors")]["log_scale"]
    assert rows[("pls", "n_components")]["high"] == 3.0 and rows[("svr", "kernel")]["choices"] == "rbf, linear"
    assert ("lasso", "max_iter") not in rows and not rows[("elastic_net", "l1_ratio")]["log_scale"]
    draws = [registry.draw_params("lasso", i, 0, limits={"max_iter": 500}) for i in range(50)]
    assert all(1e-4 <= d["alpha"] <= 1000 and d["max_iter"] == 500 and d["tol"] == 1e-4 for d in draws)
    assert {registry.draw_params("knn", i, 0)["weights"] for i in range(20)} == {"uniform", "distance"}
    assert registry.draw_params("pls", 1, 0, 2)["n_components"] in (1, 2)


def test_sweep_ranks_and_reports_failures(data):
    metrics, failed = cv.sweep(data, cv.Procedure("ridge", FEATURES), ["ridge", "knn", "pls", "nonsense"])
    assert [k for k, _ in failed] == ["nonsense"]
    ranked = cv.rank_models(metrics).orderBy("place").collect()
    assert len(ranked) == 3 and [r["rrmse"] for r in ranked] == sorted(r["rrmse"] for r in ranked)
    with pytest.raises(ValueError):
        cv.sweep(data, cv.Procedure("ridge", FEATURES), ["nonsense"])


def test_registered_model(data):
    def fit_predict(design, prep, size, params, n_cycles, seed):
        return design.withColumn("predicted", c("y_mean") + params["shift"])

    registry.register_model(registry.Model("mean", "Mean", False), [registry.Param("mean", "shift", 2.0, "linear", 0.0, 5.0)], fit_predict)
    try:
        run = cv.run_procedure(data, cv.Procedure("mean", FEATURES))
        pdf, fit, _ = fold_arrays(data, 1)
        assert np.allclose(predictions(run, 1), pdf["target"][fit].mean() + 2.0)
    finally:
        registry.unregister_model("mean")


def test_importance_ranks_the_signal(data):
    run = cv.run_procedure(data, cv.Procedure("ridge", FEATURES))
    fitted = cv.fitted_table(run).where("split = 1").first()
    rows = ds.labelled_rows(data, FEATURES, "target").withColumnRenamed("y", "actual")
    held, notes = importance.subset_rows(rows, run.folds.where("cycle = 0"), "held_out", True)
    assert held.count() == 12 and not notes
    table = importance.permutation_importance(held, FEATURES, cv.linear_score(FEATURES, fitted), 8, seed=1)
    ranked = importance.ranked(table).collect()
    assert [r["feature"] for r in ranked[:2]] == ["f0", "f1"] and ranked[0]["mean"] > 5 * abs(ranked[2]["mean"])
    again = importance.permutation_importance(held.repartition(5), FEATURES, cv.linear_score(FEATURES, fitted), 8, seed=1)
    assert {r["feature"]: round(r["mean"], 9) for r in again.collect()} == {r["feature"]: round(r["mean"], 9) for r in ranked}
    shuffled = importance.shuffled_rows(held, FEATURES, 2, 1)
    for f in FEATURES:  # a permutation: the same values in another order
        want = sorted(r[f] for r in held.collect())
        assert sorted(r[f] for r in shuffled.where((c("feature") == f) & (c("repeat") == 1)).collect()) == want
    assert importance.permutation_importance(held.limit(1), FEATURES, F.lit(1.0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_every_repeat_is_a_bijection(n):
    keys = np.array(importance.round_keys(4, 6), dtype=np.uint64)
    seen = {tuple(importance.receivers(np.arange(n), np.repeat(keys[r : r + 1], n, axis=0), n)) for r in range(6)}
    assert all(sorted(s) == list(range(n)) for s in seen) and (n < 5 or len(seen) == 6)


def test_importance_of_a_forest(data):
    run = cv.run_procedure(data, cv.Procedure("random_forest", FEATURES, params={"n_estimators": 20}))
    rows = ds.labelled_rows(data, FEATURES, "target").withColumnRenamed("y", "actual")
    ranked = importance.ranked(importance.permutation_importance(rows, FEATURES, cv.scorer(cv.stored_tables(run), 1), 4, seed=1)).collect()
    assert ranked[0]["feature"] == "f0" and ranked[0]["mean"] > 2 * ranked[1]["mean"] and ranked[0]["n_scored"] == 48


def test_a_forest_swaps_one_feature_at_a_time(data, spark):
    """The same predictions as of rows that are written out for every feature, to the last digit; missing values too."""
    rng = np.random.default_rng(4)
    x, given = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    given[::7, 1] = np.nan
    nodes = []
    for tree in range(20):
        grown, _ = trees.grow(rng.integers(0, 40, (3, 80)).astype(np.uint8), rng.normal(size=80), np.ones(80), trees.law("random_forest", {}, 1))
        nodes.append(trees._table(grown, [np.linspace(-1.5, 1.5, 40)] * 3, 0, tree, 0, 0.05))
    packed = trees.Packed(pd.concat([*nodes, trees._table(trees.Nodes(), [], 0, 20, 0, 1.0)]))
    got = packed.swapped(x, given)
    for f in range(3):
        one = x.copy()
        one[:, f] = given[:, f]
        assert (packed.total(one) == got[:, f]).all()
    assert packed.swapped(x[:0], given[:0]).shape == (0, 3)
    rows = ds.labelled_rows(data, FEATURES, "target").withColumnRenamed("y", "actual")
    score = cv.scorer(cv.stored_tables(cv.run_procedure(data, cv.Procedure("random_forest", FEATURES, params={"n_estimators": 12}))), 1)
    plain = importance.permutation_importance(rows, FEATURES, lambda df: score(df), 3, seed=1)
    quick = importance.permutation_importance(rows, FEATURES, score, 3, seed=1)
    assert {r.feature: tuple(round(v, 9) for v in r[1:]) for r in plain.collect()} == {r.feature: tuple(round(v, 9) for v in r[1:]) for r in quick.collect()}


def test_importance_subsets_fall_back(data, spark):
    rows = ds.labelled_rows(data, FEATURES, "target")
    nobody = spark.createDataFrame([("plot:99",)], "grp string")
    chosen, notes = importance.subset_rows(rows, nobody, "held_out", True)
    assert chosen.count() == 48 and len(notes) == 1
    copies, notes = importance.subset_rows(rows.where("is_aug"), nobody, "all", False)
    assert copies.count() == 32 and len(notes) == 1
    assert importance.include_augmented("held_out", True, False) is False and importance.include_augmented("all", True, False) is True


def test_stored_model_scores_like_the_run(data, tmp_path, spark):
    from plotspark.sinks import load_run, save_run

    run = cv.run_procedure(data, cv.Procedure("ridge", FEATURES))
    save_run(str(tmp_path), "r1", {"coefs": cv.fitted_table(run), "predictions": run.predictions})
    fitted = load_run(spark, str(tmp_path), "r1", "coefs")
    table = cv.score_dataset(data, fitted, FEATURES, "target", 2).toPandas().set_index("filename")["predicted"]
    assert np.allclose(table.sort_index(), predictions(run, 2).sort_index())
    with pytest.raises(ValueError):
        save_run(str(tmp_path), "r1", {"other": run.predictions})


@pytest.mark.parametrize(("model", "params", "transform"), [
    ("lasso", {"alpha": 0.5}, "none"), ("random_forest", {"n_estimators": 12}, "log"), ("hist_gbt", {"max_iter": 5, "min_samples_leaf": 3}, "none"), ("knn", {"n_neighbors": 3}, "log"),
    ("gpr", {"length_scale": 3.0, "features": 32}, "none"), ("svr", {"features": 16}, "none"), ("svr", {"kernel": "linear"}, "none")])
def test_every_model_scores_from_its_tables(data, tmp_path, spark, model, params, transform):
    from plotspark.sinks import load_run, save_run

    run = cv.run_procedure(data, cv.Procedure(model, FEATURES, params=params, transform=transform, n_splits=2))
    tables = cv.stored_tables(run)
    assert set(tables) <= set(cv.MODEL_TABLES)
    save_run(str(tmp_path), "run", tables)
    again = {name: load_run(spark, str(tmp_path), "run", name) for name in tables}
    found = cv.score_stored(data, again, "target", 2).toPandas().set_index("filename")["predicted"]
    assert np.allclose(found.sort_index(), predictions(run, 2).sort_index())
    twice = cv.score_stored(data.unionByName(data), again, "target", 2)
    assert twice.count() == 96 and twice.where("predicted IS NULL").count() == 0
    with pytest.raises(ValueError, match="split"):
        cv.scorer(again, 9)


def test_a_nested_search_is_stored_with_its_winners(data):
    run, params = cv.nested_search(data, cv.Procedure("knn", FEATURES, n_splits=2), 3, 2)
    tables = cv.stored_tables(run)
    chosen = {(r["split"], r["param"]): r["value"] for r in params.collect()}
    import json
    assert {r["split"]: json.loads(r["params"])["n_neighbors"] for r in tables["settings"].collect()} == {s: chosen[s, "n_neighbors"] for s in (1, 2)}
    found = cv.score_stored(data, tables, "target", 1).toPandas().set_index("filename")["predicted"]
    assert np.allclose(found.sort_index(), predictions(run, 1).sort_index())


@pytest.mark.parametrize(("model", "fixed"), [("svr", {"features": 16}), ("hist_gbt", {})])
def test_search_draws_only_what_a_model_accepts(data, model, fixed, monkeypatch):
    small = [p._replace(high=10) if (p.model, p.name) == ("hist_gbt", "max_iter") else p for p in registry.PARAMS]
    monkeypatch.setattr(registry, "PARAMS", small)
    proc = cv.Procedure(model, FEATURES[:2], params=fixed, n_splits=2)
    run, _ = cv.nested_search(data, proc, 2, 2)
    assert cv.fold_metrics(run).count() == 4


def test_a_trial_or_split_without_a_score_never_wins(spark):
    nan, inf = float("nan"), float("inf")
    trials = spark.createDataFrame([(0, 0, None, 1.0, 3), (0, 1, 5.0, 1.0, 3), (0, 2, nan, 1.0, 3), (0, 3, 5.0, 1.0, 3), (1, 0, inf, 1.0, 3)], "`outer` int, trial int, mean_rrmse double, mean_r2 double, n_folds bigint")
    assert [(r["outer"], r["trial"]) for r in cv.best_trials(trials).collect()] == [(0, 1)]


def test_gamma_follows_the_columns_spread(data):
    wide = data.withColumns({f: c(f) * 1000 for f in FEATURES})
    proc = cv.Procedure("svr", FEATURES, params={"features": 32}, normalize=[], n_splits=2)
    a, b = (cv.run_procedure(d, proc).predictions.orderBy("split", "filename").toPandas()["predicted"] for d in (data, wide))
    assert np.allclose(a, b, rtol=1e-4)


@pytest.mark.parametrize(("cost", "epsilon"), [(10.0, 0.1), (1000.0, 0.0), (0.01, 5.0)])
def test_support_vectors_settle_at_the_least_objective(spark, cost, epsilon, recwarn):
    from plotspark.models import rff

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (240, 3))
    y = 20 * x[:, 0] - 5 * x[:, 2] + 3 + rng.standard_t(3, 240) * 4
    rows = [(k, f"r{i}", (i + k) % 3 > 0, float(y[i]), 0.0, [float(v) for v in x[i]]) for k in range(2) for i in range(240)]
    design = spark.createDataFrame(rows, "cycle int, filename string, fit boolean, y double, y_mean double, x array<double>").repartition(3)
    found = {r["cycle"]: np.array(r["w"]) for r in rff.fit_svr(design, ["cycle"], 3, cost, epsilon).collect()}
    assert not [w for w in recwarn if "settled" in str(w.message)]
    for k, w in found.items():
        fit = (np.arange(240) + k) % 3 > 0
        goal = lambda w: w[:3] @ w[:3] / (2 * cost * fit.sum()) + np.maximum(abs(y[fit] - x[fit] @ w[:3] - w[3]) - epsilon, 0).mean()  # noqa: E731, B023
        best, at, size = goal(w), w.copy(), 1.0
        for _ in range(3000):  # a random search around the fit
            other = at + rng.normal(0, size, 4)
            size = size * 1.5 if goal(other) < best else size * 0.99
            if goal(other) < best:
                best, at = goal(other), other
        assert goal(w) <= best * 1.003


def test_nodes_are_cut_alike_by_bins_and_by_order(monkeypatch):
    rng = np.random.default_rng(8)
    bins, y, weight = rng.integers(0, 20, (7, 900)).astype(np.uint8), rng.normal(0, 1, 900), rng.integers(1, 4, 900).astype(float)
    for model, params in (("random_forest", {"min_samples_leaf": 2}), ("hist_gbt", {"l2_regularization": 0.5})):
        how = trees.law(model, params, 0)
        grown = []
        for binned, cells in ((1, 32768), (1 << 30, 1), (60, 5000)):
            monkeypatch.setattr(trees, "BINNED_ROWS", binned)
            monkeypatch.setattr(trees, "ORDERED_CELLS", cells)
            nodes, leaf = trees.grow(bins, y, weight, how)
            grown.append((nodes.feature, nodes.cut, leaf.tolist()))
            ends, at = np.unique(leaf, return_inverse=True)
            assert np.allclose(np.bincount(at, weight * y) / (np.bincount(at, weight) + how.l2), np.array(nodes.value)[ends])
        assert grown[0] == grown[1] == grown[2] and len(grown[0][0]) > 50


def test_a_large_fold_of_boosting_does_not_route_through_all_rounds(spark, monkeypatch):
    rows, _, _ = tree_rows(spark, 120, 2)
    params = {"max_iter": 5, "max_depth": 2, "min_samples_leaf": 5}
    here = trees.predict_trees(rows, trees.fit_trees(rows, "hist_gbt", params, seed=3)).toPandas()
    monkeypatch.setattr(trees, "LOCAL_ROWS", 40)
    monkeypatch.setattr(trees, "ROUNDS_A_WRITE", 2)
    known, seen = trees._histograms, []
    monkeypatch.setattr(trees, "_histograms", lambda rows, size, wanted, state, how: (seen.append(max(len(s[0]) for s in state.values())), known(rows, size, wanted, state, how))[1])
    there = trees.predict_trees(rows, trees.fit_trees(rows, "hist_gbt", params, seed=3)).toPandas()
    a, b = (d.sort_values(["cycle", "filename"])["predicted"].to_numpy() for d in (here, there))
    assert np.allclose(a, b) and max(seen) == 1
