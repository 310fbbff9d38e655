import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotspark.operators import folds as fd
from plotspark.operators import metrics as mt
from plotspark.operators import results as rs

c = F.col


def groups(spark, n, extra=()):
    return spark.createDataFrame([(f"plot:{i}",) for i in range(1, n + 1)] + [(g,) for g in extra], "grp string").repartition(3)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def as_sets(folds):
    out = {}
    for r in folds.collect():
        out.setdefault(r["cycle"], set()).add(r["grp"])
    return out


@pytest.mark.parametrize("n, size, want", [(80, 0.25, 4), (80, 0.2, 5), (80, 0.3, 3), (150, 0.25, 4), (0, 0.25, 1), (10, 0, 10)])
def test_split_caps(spark, n, size, want):
    assert value(spark, fd.max_splits_col(F.lit(n), F.lit(float(size)))) == want


@pytest.mark.parametrize("n, size, want", [(80, 0.25, 4), (80, 0.20, 5), (80, 0.34, 3), (1, 0.25, 1)])
def test_legacy_counts(spark, n, size, want):
    assert value(spark, fd.legacy_splits_col(F.lit(n), F.lit(size))) == want


@pytest.mark.parametrize("n, size, splits, want", [(20, 0.25, 6, 3), (10, 0.3, 5, 2), (10, 0.25, 1, 2), (14, 0.25, 1, 4), (150, 0.25, 4, 37), (5, 0.0001, 1, 1)])
def test_block_sizes_round_half_to_even_and_shrink(spark, n, size, splits, want):
    assert value(spark, fd.block_size_col(F.lit(n), F.lit(size), F.lit(splits))) == want


def test_systematic(spark):
    got = as_sets(fd.systematic_folds(groups(spark, 12), 3, 1 / 3))
    assert got == {0: {f"plot:{i}" for i in (1, 4, 7, 10)}, 1: {f"plot:{i}" for i in (2, 5, 8, 11)}, 2: {f"plot:{i}" for i in (3, 6, 9, 12)}}


def test_sequential_orders_numbers_before_text(spark):
    got = as_sets(fd.sequential_folds(groups(spark, 11, ["row:b", "row:a"]), 4, 0.25))
    assert got[0] == {"plot:1", "plot:2", "plot:3"} and got[3] == {"plot:10", "plot:11", "row:a"}


@pytest.mark.parametrize("mode", ["sequential", "systematic", "random_systematic"])
@pytest.mark.parametrize("n, splits, size", [(20, 6, 0.25), (13, 4, 0.25), (10, 3, 0.3)])
def test_partitions_never_hold_out_twice(spark, mode, n, splits, size):
    got = as_sets(fd.grouped_folds(groups(spark, n), mode, splits, size, 5))
    members = [g for s in got.values() for g in s]
    assert len(members) == len(set(members)) and len(got) == min(splits, fd.split_cap(groups(spark, n), size))
    assert len({len(s) for s in got.values()}) == 1


def test_random_modes_do_not_depend_on_partitioning(spark):
    for mode in ("random", "random_systematic"):
        one = as_sets(fd.grouped_folds(groups(spark, 23).coalesce(1), mode, 4, 0.2, 9))
        many = as_sets(fd.grouped_folds(groups(spark, 23).repartition(7), mode, 4, 0.2, 9))
        assert one == many
        assert one != as_sets(fd.grouped_folds(groups(spark, 23), mode, 4, 0.2, 10))
    assert all(len(s) == math.ceil(0.2 * 23) for s in as_sets(fd.random_folds(groups(spark, 23), 4, 0.2, 9)).values())


def test_sliding_window_wraps(spark):
    got = as_sets(fd.sliding_folds(groups(spark, 10), 0.3))
    assert len(got) == 4 and got[3] == {"plot:10", "plot:1", "plot:2"}
    assert {r["grp"] for r in fd.grouped_split(groups(spark, 10), "sequential", 0.3, cycle=1).collect()} == {"plot:4", "plot:5", "plot:6"}


def test_errors(spark):
    with pytest.raises(ValueError):
        fd.sequential_folds(groups(spark, 1), 2, 0.5)
    with pytest.raises(ValueError):
        fd.grouped_folds(groups(spark, 5), "sorted", 2, 0.5)


def test_membership_and_leakage(spark):
    rows = groups(spark, 8).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("filename", F.concat_ws("#", "grp", "copy"))
    folds = fd.sequential_folds(groups(spark, 8), 4, 0.25)
    sided = fd.fold_rows(rows, folds, 4)
    assert sided.count() == 64 and sided.where("held_out").count() == 16
    assert fd.held_out_rows(rows, folds, 0).count() == 4 and fd.train_rows(rows, folds, 0).count() == 12
    report = {r["law"]: r["violations"] for r in fd.leakage_report(rows, folds, 4).collect()}
    assert set(report.values()) == {0} and len(report) == 4
    broken = folds.unionByName(folds.where("cycle = 0").withColumn("cycle", F.lit(1))).where("cycle < 3")
    report = {r["law"]: r["violations"] for r in fd.leakage_report(rows, broken, 4).collect()}
    assert report["group held out twice"] == 2 and report["group never held out"] == 2


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(50, 90, 40)
    p = y + rng.normal(0, 5, 40)
    got = mt.standard_metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "actual double, predicted double")).first()
    assert got["rrmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()) / y.mean() * 100)
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["r"] == pytest.approx(np.corrcoef(y, p)[0, 1]) and got["n"] == 40
    assert got["mape"] == pytest.approx((abs(y - p) / y).mean() * 100) and got["mae"] == pytest.approx(abs(y - p).mean())


@pytest.mark.parametrize("rows, r2, r, rrmse", [
    ([(5.0, 5.0), (5.0, 5.0)], 1.0, None, 0.0), ([(5.0, 4.0), (5.0, 6.0)], 0.0, None, 20.0), ([(2.0, 1.0)], None, None, 50.0),
    ([(-1.0, 0.0), (1.0, 0.0)], 0.0, None, math.inf)])
def test_degenerate_metrics(spark, rows, r2, r, rrmse):
    got = mt.standard_metrics(spark.createDataFrame(rows, "actual double, predicted double")).first()
    assert got["r2"] == r2 and got["r"] == r and got["rrmse"] == pytest.approx(rrmse)


def test_cube_cells_overlap(spark):
    rows = [(h, a) for h in (True, False) for a in (True, False)]
    df = spark.createDataFrame(rows, "h boolean, a boolean").withColumn("cells", mt.cube_cells(c("h"), c("a")))
    sizes = {(r["h"], r["a"]): len(r["cells"]) for r in df.collect()}
    assert sizes == {(True, False): 6, (True, True): 3, (False, False): 6, (False, True): 3}
    assert mt.variant_of("overall", True, False) == "aug_orig" and mt.variant_of("held_out", True, False) == "orig_only"


def test_gap_is_a_difference_of_means(spark):
    inf = float("inf")
    cells = spark.createDataFrame([("m", 1, "held_out", 10.0), ("m", 2, "held_out", inf), ("m", 1, "train", 4.0), ("m", 2, "train", 8.0)],
                                  "model string, split int, scope string, rrmse double").withColumns({k: F.lit(0.5) for k in ("r2", "r", "mape")})
    assert rs.generalisation_gap(cells, ["model"]).first()["rrmse_gap"] == pytest.approx(4.0)


def test_bar_order_keeps_missing_last(spark):
    bars = spark.createDataFrame([(0, 2.0), (1, None), (2, 3.0), (3, None), (4, 2.0)], "position int, value double")
    order = lambda mode: [r["position"] for r in rs.bar_order(bars, mode).orderBy("place").collect()]
    assert order("none") == [0, 1, 2, 3, 4] and order("asc") == [0, 4, 2, 1, 3] and order("desc") == [2, 4, 0, 1, 3]


def test_fields(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0), (4, None), (5, 5.0)], "plot int, v double")
    z = {r["plot"]: r["z"] for r in rs.z_scores(df, "v").collect()}
    assert z[1] == pytest.approx(-2 / math.sqrt(2)) and z[4] is None
    pct = {r["plot"]: r["pct"] for r in rs.percentile_ranks(df, "v").collect()}
    assert pct == {1: 0.0, 2: 25.0, 3: 25.0, 4: None, 5: 75.0}
    assert {r["norm"] for r in rs.range_norm(df.where("plot = 1"), "v").collect()} == {0.0}
    flat = df.where("plot in (2, 3)")
    assert {r["z"] for r in rs.z_scores(flat, "v").collect()} == {None}


def test_distribution_and_density(spark):
    rng = np.random.default_rng(4)
    v = np.append(rng.normal(10, 2, 80), 40.0)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    facts = rs.distribution(df, "v")
    got = facts.first()
    q1, q2, q3 = np.percentile(v, [25, 50, 75])
    assert (got["q1"], got["median"], got["q3"]) == (pytest.approx(q1), pytest.approx(q2), pytest.approx(q3))
    inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
    assert got["whisker_high"] == inside.max() and got["whisker_low"] == inside.min() and got["fliers"] == len(v) - len(inside)
    curve = rs.kernel_density(df, "v", facts).orderBy("i").collect()
    xs = np.linspace(v.min(), v.max(), 200)
    bw = len(v) ** -0.2 * v.std(ddof=1)
    want = np.exp(-0.5 * ((xs[:, None] - v[None, :]) / bw) ** 2).sum(axis=1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in curve], want)
    assert rs.normal_curve(facts).count() == 200


def test_chart_text(spark):
    values = spark.createDataFrame([("PLS", 14.42, 0), ("kNN", None, 1), ("RF", 13.0, 2)], "label string, value double, position int")
    line = rs.values_as_text(values, "rRMSE (%)", with_average=True).first()[0]
    assert line == "PLS: 14.42 rRMSE (%), kNN: n/a, RF: 13 rRMSE (%), Average: 13.71 rRMSE (%)"
    assert rs.values_as_text(values, "%", as_table=True).first()[0] == "\t%\nPLS\t14.42\nkNN\tn/a\nRF\t13"


def test_shared_range(spark):
    df = spark.createDataFrame([(-1.0,), (3.0,), (None,)], "value double")
    row = rs.shared_range(df).first()
    assert row["low"] == pytest.approx(-1.2) and row["high"] == pytest.approx(3.2)
    assert rs.shared_range(df.where("value is null")).count() == 0
