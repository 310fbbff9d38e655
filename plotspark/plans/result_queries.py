"""Queries over folds, prediction tables and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotspark.operators import folds as fd
from plotspark.operators import metrics as mt
from plotspark.operators import results as rs
from plotspark.models import cv, importance
from plotspark.models import target as tg
from plotspark.plans import views
from plotspark.plans.registry import query, rounded, rounded_all

c = F.col

# ---------------------------------------------------------------------------------------- folds
GROUPS_CTE = """
grps AS (SELECT CASE WHEN s_suppkey % 10 = 7 THEN concat('row:', s_name) ELSE concat('plot:', CAST(s_suppkey AS VARCHAR)) END AS grp,
                CASE WHEN s_suppkey % 10 <> 7 THEN s_suppkey END AS num FROM supplier),
ranked AS (SELECT grp, row_number() OVER (ORDER BY num IS NULL, num, grp) AS rn, count(*) OVER () AS n FROM grps)
"""


def _groups(spark, sf_dir):
    key = c("s_suppkey")
    grp = F.when(key % 10 == 7, F.concat(F.lit("row:"), c("s_name"))).otherwise(F.concat(F.lit("plot:"), key.cast("string")))
    return views.table(spark, sf_dir, "supplier").select(grp.alias("grp"))


def block_sql(test_size: str, splits: int) -> str:
    return f"greatest(1, least(n, CAST(round_even({test_size} * n, 0) AS BIGINT), n // {splits}))"


SIZES = ((0.25, 4), (0.2, 5), (0.3, 3), (0.34, 6), (0.5, 2))


@query("w01_block_sizes", f"""
SELECT s_nationkey AS nation, n, test_size, n_splits, greatest(1, least(n, CAST(round_even(test_size * n, 0) AS BIGINT), n // n_splits)) AS block
FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
CROSS JOIN (VALUES {', '.join(f'({t}e0, {k})' for t, k in SIZES)}) AS v(test_size, n_splits)""")
def block_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir).select("nation", "n", "test_size", "n_splits", fd.block_size_col(c("n"), c("test_size"), c("n_splits")).alias("block"))


def _sizes(spark, sf_dir):
    sizes = F.explode(F.array(*[F.struct(F.lit(t).alias("test_size"), F.lit(k).alias("n_splits")) for t, k in SIZES])).alias("s")
    nations = views.table(spark, sf_dir, "supplier").groupBy(c("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return nations.select("nation", "n", sizes).select("nation", "n", "s.*")


@query("w07_split_caps", f"""
SELECT s_nationkey AS nation, n, test_size, greatest(1, least(n, CAST(floor(1 / test_size) AS BIGINT))) AS cap,
       CASE WHEN n < 2 THEN 1 ELSE greatest(1, CAST(ceil(n / CAST(greatest(1, least(n - 1, CAST(round_even(test_size * n, 0) AS BIGINT))) AS DOUBLE)) AS BIGINT)) END AS legacy
FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
CROSS JOIN (VALUES {', '.join(f'({t}e0, {k})' for t, k in SIZES)}) AS v(test_size, n_splits)""")
def split_caps(spark, sf_dir):
    return _sizes(spark, sf_dir).select(
        "nation", "n", "test_size", fd.max_splits_col(c("n"), c("test_size")).alias("cap"), fd.legacy_splits_col(c("n"), c("test_size")).alias("legacy"))


@query("w02_sequential_folds", views.with_views(f"""
SELECT CAST((rn - 1) // block AS INT) AS cycle, grp FROM (SELECT *, {block_sql('0.3e0', 3)} AS block FROM ranked) WHERE (rn - 1) // block < 3""", ctes=GROUPS_CTE))
def sequential_folds(spark, sf_dir):
    return fd.grouped_folds(_groups(spark, sf_dir), "sequential", 5, 0.3)


@query("w03_systematic_folds", views.with_views(f"""
SELECT CAST((rn - 1) % 3 AS INT) AS cycle, grp FROM (SELECT *, {block_sql('0.3e0', 3)} AS block FROM ranked) WHERE (rn - 1) // 3 < block""", ctes=GROUPS_CTE))
def systematic_folds(spark, sf_dir):
    return fd.grouped_folds(_groups(spark, sf_dir), "systematic", 3, 0.3)


@query("w04_random_systematic_folds", views.with_views(f"""
SELECT CAST((rn - 1) // block AS INT) AS cycle, grp FROM (
  SELECT *, {block_sql('0.25e0', 4)} AS block FROM (SELECT grp, row_number() OVER (ORDER BY md5(concat('11:', grp))) AS rn, count(*) OVER () AS n FROM grps))
WHERE (rn - 1) // block < 4""", ctes=GROUPS_CTE))
def random_systematic_folds(spark, sf_dir):
    return fd.grouped_folds(_groups(spark, sf_dir), "random_systematic", 4, 0.25, 11)


@query("w05_random_folds", views.with_views("""
SELECT cycle, grp FROM (
  SELECT CAST(i AS INT) AS cycle, grp, row_number() OVER (PARTITION BY i ORDER BY md5(concat(CAST(i + 11 AS VARCHAR), ':', grp))) AS rn, n
  FROM ranked CROSS JOIN range(6) AS r(i)) WHERE rn <= ceil(0.25e0 * n)""", ctes=GROUPS_CTE))
def random_folds(spark, sf_dir):
    return fd.grouped_folds(_groups(spark, sf_dir), "random", 6, 0.25, 11)


@query("w06_sliding_folds", views.with_views("""
SELECT CAST(i AS INT) AS cycle, grp FROM (
  SELECT *, greatest(1, least(n - 1, CAST(round_even(0.34e0 * n, 0) AS BIGINT))) AS block FROM ranked) CROSS JOIN range(10) AS r(i)
WHERE i < ceil(n / CAST(block AS DOUBLE)) AND ((rn - 1 - (i * block) % n) % n + n) % n < block""", ctes=GROUPS_CTE))
def sliding_folds(spark, sf_dir):
    return fd.sliding_folds(_groups(spark, sf_dir), 0.34)


DATA_FOLDS_CTE = """
data AS (SELECT *, concat('plot:', CAST(plot AS VARCHAR)) AS grp, aug > 0 AS is_aug FROM v_dataset),
pl AS (SELECT grp, row_number() OVER (ORDER BY plot) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp, plot FROM data)),
folds AS (SELECT grp, CAST((rn - 1) // greatest(1, least(n, CAST(round_even(0.25e0 * n, 0) AS BIGINT), n // 4)) AS INT) AS fold FROM pl),
sided AS (SELECT d.*, CAST(i AS INT) AS cycle, coalesce(f.fold = i, false) AS held_out FROM data d JOIN folds f USING (grp) CROSS JOIN range(4) AS r(i))
"""


def labelled(spark, sf_dir, features=("f0", "f1", "f2", "f3")):
    from plotspark.models.design import labelled_rows

    return labelled_rows(views.dataset(spark, sf_dir), features, "target")


@query("j08_fold_membership", views.with_views("""
SELECT cycle, filename, held_out FROM sided""", "v_dataset", ctes=DATA_FOLDS_CTE))
def fold_membership(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return fd.fold_rows(rows, fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25), 4).select("cycle", "filename", "held_out")


@query("u04_leakage_report", views.with_views("""
SELECT law, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'group on both sides' AS law, count(*) AS violations FROM (SELECT cycle, grp FROM sided GROUP BY cycle, grp HAVING count(DISTINCT held_out) > 1)
  UNION ALL SELECT 'group held out twice', count(*) FROM (SELECT grp FROM folds GROUP BY grp HAVING count(*) > 1)
  UNION ALL SELECT 'group never held out', count(*) FROM (SELECT grp FROM data EXCEPT SELECT grp FROM folds WHERE fold < 4)
  UNION ALL SELECT 'held-out group without rows', count(*) FROM (SELECT grp FROM folds EXCEPT SELECT grp FROM data))""", "v_dataset", ctes=DATA_FOLDS_CTE))
def leakage_report(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    folds = fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25).persist()
    return fd.leakage_report(rows, folds, 4)


# -------------------------------------------------------------------------------------- metrics
RRMSE_SQL = "CASE WHEN abs(avg({y})) = 0 THEN CAST('inf' AS DOUBLE) ELSE sqrt(avg(pow({y} - {p}, 2))) / abs(avg({y})) * 100 END"
R2_SQL = ("CASE WHEN count({y}) >= 2 THEN CASE WHEN min({y}) = max({y}) THEN CASE WHEN sum(pow({y} - {p}, 2)) = 0 THEN 1e0 ELSE 0e0 END "
          "ELSE 1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count({y})) END END")
R_SQL = "CASE WHEN count({y}) >= 2 AND min({y}) < max({y}) AND min({p}) < max({p}) THEN corr({y}, {p}) END"
MAPE_SQL = "avg(abs({y} - {p}) / greatest(abs({y}), 2.220446049250313e-16)) * 100"


def metrics_sql(y: str = "actual", p: str = "predicted", digits: int | None = 6) -> str:
    parts = {"rrmse": RRMSE_SQL, "r2": R2_SQL, "r": R_SQL, "mape": MAPE_SQL, "mae": "avg(abs({y} - {p}))"}
    wrap = (lambda s: f"round({s}, {digits})") if digits is not None else (lambda s: s)
    return ", ".join(f"{wrap(s.format(y=y, p=p))} AS {name}" for name, s in parts.items()) + f", count({y}) AS n"


CUBE_CTE = f"""
cells AS (SELECT * FROM (VALUES ('held_out', 'orig_only', false, false, true, false), ('held_out', 'with_aug', false, false, true, true),
  ('train', 'orig_only', true, false, false, false), ('train', 'with_aug', true, true, false, false),
  ('overall', 'orig_orig', true, false, true, false), ('overall', 'orig_aug', true, false, true, true),
  ('overall', 'aug_orig', true, true, true, false), ('overall', 'aug_aug', true, true, true, true)) AS t(scope, variant, use_t, aug_t, use_v, aug_v)),
cube AS (SELECT model, split, scope, variant, {metrics_sql(digits=None)} FROM v_predictions JOIN cells
         ON (role = 'T' AND use_t AND (aug_t OR aug = 0)) OR (role = 'V' AND use_v AND (aug_v OR aug = 0)) GROUP BY model, split, scope, variant),
chosen AS (SELECT * FROM cube WHERE (scope, variant) IN (('held_out', 'orig_only'), ('train', 'with_aug'), ('overall', 'aug_orig')))
"""


def cube_of(spark, sf_dir):
    return mt.metric_cube(views.predictions(spark, sf_dir), ["model", "split"], c("role") == "V", c("aug") > 0)


def chosen_cells(spark, sf_dir):
    return mt.selected_cells(cube_of(spark, sf_dir), train_aug=True, score_aug=False)


@query("a28_a32_standard_metrics", views.with_views(f"SELECT model, split, role, {metrics_sql()} FROM v_predictions GROUP BY model, split, role", "v_predictions"))
def standard_metrics(spark, sf_dir):
    return rounded_all(mt.standard_metrics(views.predictions(spark, sf_dir), ["model", "split", "role"]))


@query("a29_a30_degenerate_metrics", f"""
SELECT s_nationkey, {metrics_sql('y', 'p')} FROM (SELECT s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN 0e0 WHEN s_nationkey % 3 = 1 THEN 5e0 ELSE s_acctbal END AS y,
       CASE WHEN s_nationkey % 2 = 0 THEN 5e0 ELSE s_acctbal / 2 END AS p FROM supplier WHERE s_nationkey % 3 <> 0) GROUP BY s_nationkey
UNION ALL SELECT s_nationkey, CAST('inf' AS DOUBLE), CASE WHEN count(*) >= 2 THEN 0e0 END, NULL, round(avg(abs(p) / 2.220446049250313e-16) * 100, 6), round(avg(abs(p)), 6), count(*)
FROM (SELECT s_nationkey, CASE WHEN s_nationkey % 2 = 0 THEN 5e0 ELSE s_acctbal / 2 END AS p FROM supplier WHERE s_nationkey % 3 = 0) GROUP BY s_nationkey""")
def degenerate_metrics(spark, sf_dir):
    nation = c("s_nationkey")
    rows = views.table(spark, sf_dir, "supplier").select(
        "s_nationkey", F.when(nation % 3 == 0, 0.0).when(nation % 3 == 1, 5.0).otherwise(c("s_acctbal")).alias("actual"),
        F.when(nation % 2 == 0, 5.0).otherwise(c("s_acctbal") / 2).alias("predicted"))
    return rounded_all(mt.standard_metrics(rows, ["s_nationkey"]))


@query("a34_metric_cube", views.with_views(f"""
SELECT model, split, scope, variant, round(rrmse, 6) AS rrmse, round(r2, 6) AS r2, round(r, 6) AS r, round(mape, 6) AS mape, round(mae, 6) AS mae, n FROM cube""",
    "v_predictions", ctes=CUBE_CTE))
def metric_cube(spark, sf_dir):
    return rounded_all(cube_of(spark, sf_dir))


@query("a35_cube_lookup", views.with_views("""
SELECT model, split, round(rrmse, 6) AS rrmse, n FROM cube WHERE scope = 'held_out' AND variant = 'with_aug' AND split <> 3
UNION ALL SELECT model, split, round(rrmse, 6), n FROM cube WHERE scope = 'held_out' AND variant = 'orig_only' AND split = 3""", "v_predictions", ctes=CUBE_CTE))
def cube_lookup(spark, sf_dir):
    cube = cube_of(spark, sf_dir)
    partial = cube.where(~((c("split") == 3) & (c("variant") == "with_aug")))  # as if one split had been stored without its cube
    stored = cube.where(c("variant") == "orig_only")
    found = mt.cube_lookup(partial, ["model", "split"], "held_out", mt.variant_of("held_out", False, True), stored)
    return found.select("model", "split", rounded("rrmse").alias("rrmse"), "n")


@query("a36_mean_metrics", views.with_views("""
SELECT model, scope, round(avg(rrmse), 6) AS rrmse, round(avg(r2), 6) AS r2, round(avg(r), 6) AS r, round(avg(mape), 6) AS mape FROM chosen GROUP BY model, scope""",
    "v_predictions", ctes=CUBE_CTE))
def mean_metrics(spark, sf_dir):
    return rounded_all(rs.mean_metrics(chosen_cells(spark, sf_dir), ["model", "scope"]))


@query("a37_fold_spread", views.with_views("""
SELECT model, round(avg(rrmse), 6) AS mean_rrmse, round(stddev_pop(rrmse), 6) AS std_rrmse FROM chosen WHERE scope = 'held_out' GROUP BY model""",
    "v_predictions", ctes=CUBE_CTE))
def fold_spread(spark, sf_dir):
    return rounded_all(rs.fold_spread(chosen_cells(spark, sf_dir), ["model"]))


SERIES_CTE = CUBE_CTE.rstrip() + """,
long AS (SELECT model, split, scope, metric, value FROM chosen UNPIVOT (value FOR metric IN (rrmse, r2, r, mape))),
series AS (SELECT model, split, metric, scope AS kind, value FROM long
           UNION ALL SELECT h.model, h.split, h.metric, 'delta', h.value - t.value FROM long h JOIN long t
             ON h.model = t.model AND h.split = t.split AND h.metric = t.metric AND h.scope = 'held_out' AND t.scope = 'train')
"""


@query("a38_split_consistency", views.with_views("""
SELECT model, kind, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM series GROUP BY model, kind, metric""", "v_predictions", ctes=SERIES_CTE))
def split_consistency(spark, sf_dir):
    return rounded_all(rs.consistency_summary(rs.consistency_series(chosen_cells(spark, sf_dir), ["model"]), ["model"]))


@query("a39_generalisation_gap", views.with_views("""
SELECT model, round(avg(rrmse) FILTER (WHERE scope = 'held_out') - avg(rrmse) FILTER (WHERE scope = 'train'), 6) AS rrmse_gap,
       round(avg(r2) FILTER (WHERE scope = 'held_out') - avg(r2) FILTER (WHERE scope = 'train'), 6) AS r2_gap,
       round(avg(r) FILTER (WHERE scope = 'held_out') - avg(r) FILTER (WHERE scope = 'train'), 6) AS r_gap,
       round(avg(mape) FILTER (WHERE scope = 'held_out') - avg(mape) FILTER (WHERE scope = 'train'), 6) AS mape_gap
FROM chosen GROUP BY model""", "v_predictions", ctes=CUBE_CTE))
def generalisation_gap(spark, sf_dir):
    return rounded_all(rs.generalisation_gap(chosen_cells(spark, sf_dir), ["model"]))


@query("a40_fit_lines", views.with_views(f"""
SELECT model, split, role, round(regr_slope(predicted, actual), 6) AS slope, round(regr_intercept(predicted, actual), 6) AS intercept, {metrics_sql()}
FROM v_predictions GROUP BY model, split, role""", "v_predictions"))
def fit_lines(spark, sf_dir):
    return rounded_all(rs.fit_line(views.predictions(spark, sf_dir), ["model", "split", "role"]))


@query("a41_model_bars", views.with_views("""
SELECT model, kind, round(avg(value), 6) AS value FROM series WHERE metric = 'rrmse' GROUP BY model, kind
UNION ALL SELECT concat('best of ', model), kind, round(value, 6) FROM series JOIN (
  SELECT model, min_by(split, struct_pack(a := rrmse, b := split)) AS split FROM chosen WHERE scope = 'held_out' GROUP BY model) USING (model, split) WHERE metric = 'rrmse'""",
    "v_predictions", ctes=SERIES_CTE))
def model_bars(spark, sf_dir):
    cells = chosen_cells(spark, sf_dir)
    best = rs.best_splits(cells, ["model"])
    mean = rs.model_values(cells, ["model"], "rrmse")
    one = rs.model_values(cells, ["model"], "rrmse", best).withColumn("model", F.concat(F.lit("best of "), "model"))
    return rounded_all(mean.unionByName(one))


BARS_CTE = SERIES_CTE.rstrip() + """,
bars AS (SELECT model, kind, avg(value) AS value FROM series WHERE metric = 'mape' GROUP BY model, kind),
members AS (SELECT DISTINCT CASE WHEN model < '3' THEN 'urgent' ELSE 'calm' END AS bar, model FROM v_predictions)
"""


@query("a41_combined_bars", views.with_views("""
SELECT bar, kind, how, round(value, 6) AS value FROM (
  SELECT bar, kind, 'avg' AS how, avg(value) AS value FROM bars JOIN members USING (model) GROUP BY bar, kind
  UNION ALL SELECT bar, kind, 'min', min(value) FROM bars JOIN members USING (model) GROUP BY bar, kind
  UNION ALL SELECT bar, kind, 'max', max(value) FROM bars JOIN members USING (model) GROUP BY bar, kind
  UNION ALL SELECT bar, kind, 'sum', sum(value) FROM bars JOIN members USING (model) GROUP BY bar, kind)""", "v_predictions", ctes=BARS_CTE))
def combined_bars(spark, sf_dir):
    values = rs.model_values(chosen_cells(spark, sf_dir), ["model"], "mape")
    members = views.predictions(spark, sf_dir).select(F.when(c("model") < "3", "urgent").otherwise("calm").alias("bar"), "model").distinct()
    out = None
    for how in ("avg", "min", "max", "sum"):
        part = rs.combined_bars(values, members, how).withColumn("how", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return rounded_all(out)


@query("a41_shared_range", views.with_views("""
SELECT round(lo - CASE WHEN lo < 0 THEN pad ELSE 0 END, 6) + 0e0 AS low, round(hi + pad, 6) AS high FROM (
  SELECT *, coalesce(nullif((hi - lo) * 0.05e0, 0), 1) AS pad FROM (SELECT least(0, min(value)) AS lo, greatest(0, max(value)) AS hi FROM bars))""", "v_predictions", ctes=BARS_CTE))
def shared_range(spark, sf_dir):
    return rounded_all(rs.shared_range(rs.model_values(chosen_cells(spark, sf_dir), ["model"], "mape")))


@query("a41_mixed_targets", "SELECT count(DISTINCT o_orderstatus) AS targets, count(DISTINCT o_orderstatus) > 1 AS mixed FROM orders")
def mixed_targets(spark, sf_dir):
    return rs.mixed_targets(views.table(spark, sf_dir, "orders").select(c("o_orderstatus").alias("target")))


@query("a43_parameter_stability", views.with_views("""
SELECT model, param, round(min(value), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS high FROM (
  SELECT model, metric AS param, value FROM (SELECT model, split, scope, variant, rrmse, mape FROM cube) UNPIVOT (value FOR metric IN (rrmse, mape))) GROUP BY model, param""",
    "v_predictions", ctes=CUBE_CTE))
def parameter_stability(spark, sf_dir):
    params = cube_of(spark, sf_dir).select("model", F.explode(F.array(
        F.struct(F.lit("rrmse").alias("param"), c("rrmse").alias("value")), F.struct(F.lit("mape").alias("param"), c("mape").alias("value")))).alias("p")).select("model", "p.*")
    return rounded_all(rs.parameter_stability(params, ["model"]))


@query("a44_smearing_factor", views.with_views("""
SELECT model, split, round(avg(exp(ln(1 + actual) - ln(1 + predicted))), 6) AS smear FROM v_predictions WHERE role = 'T' GROUP BY model, split""", "v_predictions"))
def smearing_factor(spark, sf_dir):
    rows = views.predictions(spark, sf_dir).select(
        "model", "split", (c("role") == "T").alias("fit"), F.log1p("actual").alias("y"), F.log1p("predicted").alias("predicted"))
    return rounded_all(tg.smearing_factors(rows, ["model", "split"]))


DIST_CTE = """
vals AS (SELECT c_mktsegment AS segment, c_acctbal AS v FROM customer),
facts AS (SELECT segment, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, stddev_samp(v) AS sd_samp, min(v) AS low, max(v) AS high,
                 quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM vals GROUP BY segment)
"""


def _balances(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("segment"), c("c_acctbal").alias("v"))


@query("a45_distribution", views.with_views("""
SELECT f.segment, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd_samp, 6) AS sd_samp, round(low, 4) AS low, round(high, 4) AS high, round(q1, 4) AS q1,
       round(median, 4) AS median, round(q3, 4) AS q3, round(least(wl, q1), 4) AS whisker_low, round(greatest(wh, q3), 4) AS whisker_high, fliers
FROM facts f JOIN (SELECT segment, min(v) FILTER (WHERE v >= q1 - 1.5e0 * (q3 - q1)) AS wl, max(v) FILTER (WHERE v <= q3 + 1.5e0 * (q3 - q1)) AS wh,
  count(*) FILTER (WHERE v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) AS fliers FROM vals JOIN facts USING (segment) GROUP BY segment) w ON w.segment = f.segment""", ctes=DIST_CTE))
def distribution(spark, sf_dir):
    out = rs.distribution(_balances(spark, sf_dir), "v", ["segment"])
    fine = {"mean", "sd", "sd_samp"}
    return out.select("segment", "n", *[rounded(k, 6 if k in fine else 4).alias(k) for k in (
        "mean", "sd", "sd_samp", "low", "high", "q1", "median", "q3", "whisker_low", "whisker_high")], "fliers")


@query("a45_normal_curve", views.with_views("""
SELECT segment, CAST(i AS INT) AS i, round(mean - 4 * sd + i * (8 * sd / 199), 4) AS x,
       round(exp(-0.5e0 * pow((mean - 4 * sd + i * (8 * sd / 199) - mean) / sd, 2)) / (sd * sqrt(2 * pi())), 10) AS density
FROM facts CROSS JOIN range(200) AS r(i)""", ctes=DIST_CTE))
def normal_curve(spark, sf_dir):
    curve = rs.normal_curve(rs.distribution(_balances(spark, sf_dir), "v", ["segment"]))
    return curve.select("segment", "i", rounded("x", 4).alias("x"), rounded("density", 10).alias("density"))


@query("a45_kernel_density", views.with_views("""
SELECT CAST(i AS INT) AS i, round(x, 6) AS x, round(sum(exp(-0.5e0 * pow((x - v) / bw, 2))) / (max(n) * max(bw) * sqrt(2 * pi())), 8) AS density
FROM (SELECT i, low + i * ((high - low) / 199) AS x, bw, n FROM f CROSS JOIN range(200) AS r(i)) CROSS JOIN v_dataset_target GROUP BY i, x""", "v_dataset", ctes="""
v_dataset_target AS (SELECT target AS v FROM v_dataset),
f AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, pow(count(*), -0.2e0) * stddev_samp(v) AS bw FROM v_dataset_target)"""))
def kernel_density(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    curve = rs.kernel_density(data, "target", rs.distribution(data, "target"))
    return curve.select("i", rounded("x").alias("x"), rounded("density", 8).alias("density"))


# --------------------------------------------------------------------------- prediction tables
@query("p13_prediction_rows", views.with_views("""
SELECT model, split, plot, aug, round(actual, 9) AS actual, round(predicted, 9) AS predicted, round(CASE WHEN actual <> 0 THEN abs(predicted - actual) / abs(actual) * 100 END, 9) AS error_pct, role
FROM v_predictions""", "v_predictions"))
def prediction_rows(spark, sf_dir):
    rows = views.predictions(spark, sf_dir)
    key = F.concat_ws("|", "model", "split", "plot")
    members = rows.where(c("role") == "T").select(key.alias("member"))
    table = rs.plot_table(rows.drop("role").withColumn("member", key), members, "member")
    return rounded_all(table.select("model", "split", "plot", "aug", "actual", "predicted", "error_pct", "role"), 9)


@query("u01_pooled_predictions", views.with_views(f"SELECT model, {metrics_sql()} FROM v_predictions WHERE role = 'V' AND aug = 0 GROUP BY model", "v_predictions"))
def pooled_predictions(spark, sf_dir):
    return rounded_all(mt.standard_metrics(rs.pooled_held_out(views.predictions(spark, sf_dir), False), ["model"]))


@query("u02_role_series", views.with_views("SELECT model, split, plot, aug, round(actual, 9) AS actual, round(predicted, 9) AS predicted FROM v_predictions WHERE role = 'T'", "v_predictions"))
def role_series(spark, sf_dir):
    return rounded_all(rs.role_series(views.predictions(spark, sf_dir), "T", True).select("model", "split", "plot", "aug", "actual", "predicted"), 9)


@query("j06_map_overlay", views.with_views("""
SELECT CAST(NULL AS DOUBLE) AS error_pct, '' AS role, plot, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM v_dataset WHERE aug = 2
UNION ALL SELECT round(abs(f1), 6), CASE WHEN plot % 4 = 0 THEN 'V' ELSE 'T' END, plot, round(f0, 6), round(f1, 6) FROM v_dataset WHERE aug = 0""", "v_dataset"))
def map_overlay(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    files = data.select("plot", "aug", c("filename").alias("file"))
    features = data.select("filename", "f0", "f1")
    predictions = data.select("plot", "aug", F.abs("f1").alias("error_pct"), F.when(c("plot") % 4 == 0, "V").otherwise("T").alias("role"))
    return rounded_all(rs.map_rows(files, features, 2).unionByName(rs.map_rows(files, features, 0, predictions)))


# --------------------------------------------------------------------------------- map fields
@query("w10_z_scores", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def z_scores(spark, sf_dir):
    return rounded_all(rs.z_scores(views.table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "z"))


@query("w11_percentile_ranks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((rank() OVER (ORDER BY l_quantity) - 1) * 1e0 / count(*) OVER () * 100, 6) AS pct FROM lineitem")
def percentile_ranks(spark, sf_dir):
    return rounded_all(rs.percentile_ranks(views.table(spark, sf_dir, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pct"))


@query("w11_price_ranks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round((rank() OVER (ORDER BY l_extendedprice) - 1) * 1e0 / count(*) OVER () * 100, 6) AS pct FROM lineitem")
def price_ranks(spark, sf_dir):
    """Many different values close together, so that fine buckets are needed."""
    return rounded_all(rs.percentile_ranks(views.table(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "pct"))


@query("w13_range_norm", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS norm FROM customer")
def range_norm(spark, sf_dir):
    return rounded_all(rs.range_norm(views.table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "norm"))


@query("w12_best_splits", views.with_views("""
SELECT model, min_by(split, struct_pack(a := rrmse, b := split)) AS best_split, round(min(rrmse), 6) AS best_rrmse FROM chosen WHERE scope = 'held_out' GROUP BY model""",
    "v_predictions", ctes=CUBE_CTE))
def best_splits(spark, sf_dir):
    return rounded_all(rs.best_splits(chosen_cells(spark, sf_dir), ["model"]))


@query("w12_active_splits", views.with_views("""
SELECT model, CASE WHEN model < '3' THEN 2 ELSE min_by(split, struct_pack(a := rrmse, b := split)) END AS split FROM chosen WHERE scope = 'held_out' GROUP BY model""",
    "v_predictions", ctes=CUBE_CTE))
def active_splits(spark, sf_dir):
    return rs.active_splits(chosen_cells(spark, sf_dir), ["model"], F.when(c("model") < "3", F.lit(2)).otherwise(F.lit(99)))


@query("w14_fold_curve", views.with_views("""
SELECT model, split, round(max(rrmse) FILTER (WHERE scope = 'held_out'), 6) AS held_out, round(max(rrmse) FILTER (WHERE scope = 'train'), 6) AS train FROM chosen GROUP BY model, split""",
    "v_predictions", ctes=CUBE_CTE))
def fold_curve(spark, sf_dir):
    pick = lambda scope: rounded(F.max(F.when(c("scope") == scope, c("rrmse")))).alias(scope)
    return chosen_cells(spark, sf_dir).groupBy("model", "split").agg(pick("held_out"), pick("train"))


# ------------------------------------------------------------------------------------ rankings
@query("k01_model_ranking", views.with_views("""
SELECT *, row_number() OVER (ORDER BY rrmse NULLS LAST, model) AS place FROM (
  SELECT model, round(avg(rrmse) FILTER (WHERE scope = 'held_out'), 6) AS rrmse, round(avg(r2) FILTER (WHERE scope = 'held_out'), 6) AS r2, round(avg(r) FILTER (WHERE scope = 'held_out'), 6) AS r,
         round(avg(mape) FILTER (WHERE scope = 'held_out'), 6) AS mape, round(avg(rrmse) FILTER (WHERE scope = 'train'), 6) AS train_rrmse FROM chosen GROUP BY model)""",
    "v_predictions", ctes=CUBE_CTE))
def model_ranking(spark, sf_dir):
    return rounded_all(cv.rank_models(chosen_cells(spark, sf_dir))).withColumn("place", c("place").cast("bigint"))


@query("k02_bar_order", """
SELECT nation, round(value, 6) AS value, mode, row_number() OVER (PARTITION BY mode ORDER BY CASE WHEN mode <> 'none' AND value IS NULL THEN 1 ELSE 0 END,
       CASE mode WHEN 'asc' THEN value WHEN 'desc' THEN -value ELSE 0 END, nation) AS place
FROM (SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 6 <> 2 THEN avg(c_acctbal) END AS value FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
CROSS JOIN (VALUES ('none'), ('asc'), ('desc')) AS m(mode)""")
def bar_order(spark, sf_dir):
    bars = views.table(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("value"))
    bars = views.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("nation")).join(bars, "nation", "left")
    bars = bars.withColumn("value", F.when(c("nation") % 6 != 2, c("value")))
    out = None
    for mode in ("none", "asc", "desc"):
        part = rs.bar_order(bars, mode, "nation").withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out.select("nation", rounded("value").alias("value"), "mode", c("place").cast("bigint").alias("place"))


@query("k03_importance_top", "SELECT feature, round(mean, 6) AS mean FROM (SELECT p_brand AS feature, avg(p_retailprice) AS mean FROM part GROUP BY p_brand) ORDER BY mean DESC, feature LIMIT 5")
def importance_top(spark, sf_dir):
    scores = views.table(spark, sf_dir, "part").groupBy(c("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("mean"))
    return importance.ranked(scores, 5).select("feature", rounded("mean").alias("mean"))


@query("s10_run_listing", views.with_views("""
SELECT model, label, row_number() OVER (ORDER BY saved_at DESC, model) AS place FROM (
  SELECT model, saved_at, concat('[ML] ', model, CASE WHEN model < '3' THEN ' (AUG)' ELSE '' END, ' (nested CV) — biomass (rRMSE ', format('{:.3g}', rrmse), '%, ', saved_at, ')') AS label
  FROM (SELECT model, avg(rrmse) AS rrmse FROM chosen WHERE scope = 'held_out' GROUP BY model)
  JOIN (SELECT o_orderpriority AS model, strftime(max(o_orderdate), '%Y-%m-%d') AS saved_at FROM orders GROUP BY o_orderpriority) USING (model))""", "v_predictions", ctes=CUBE_CTE))
def run_listing(spark, sf_dir):
    from pyspark.sql import Window

    from plotspark.sinks import list_runs

    saved = views.table(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("model")).agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("saved_at"))
    runs = rs.fold_spread(chosen_cells(spark, sf_dir), ["model"]).join(saved, "model").select(
        "model", "saved_at", c("mean_rrmse").alias("rrmse"), F.lit("biomass").alias("target"), (c("model") < "3").alias("augmented"), F.lit(True).alias("nested"))
    foreign = runs.limit(1).withColumn("saved_at", F.lit(None).cast("string"))
    listed = list_runs(runs.unionByName(foreign))
    place = F.row_number().over(Window.orderBy(c("saved_at").desc(), c("model")))  # one row per run
    return listed.select("model", "label", place.cast("bigint").alias("place"))


@query("p17_chart_text", views.with_views("""
SELECT concat(string_agg(concat(model, ': ', format('{:.4g}', v), ' rRMSE (%)'), ', ' ORDER BY model), ', Average: ', format('{:.4g}', avg(v)), ' rRMSE (%)') AS text FROM held
UNION ALL SELECT concat(chr(9), 'rRMSE (%)', chr(10), string_agg(concat(model, chr(9), format('{:.4g}', v)), chr(10) ORDER BY model), chr(10), 'Average', chr(9), format('{:.4g}', avg(v))) FROM held""",
    "v_predictions", ctes=CUBE_CTE.rstrip() + """,
held AS (SELECT model, avg(rrmse) AS v FROM chosen WHERE scope = 'held_out' GROUP BY model)"""))
def chart_text(spark, sf_dir):
    values = rs.model_values(chosen_cells(spark, sf_dir), ["model"], "rrmse").where(c("kind") == "held_out")
    values = values.select(c("model").alias("label"), "value", c("model").alias("position"))
    line = rs.values_as_text(values, "rRMSE (%)", with_average=True)
    return line.unionByName(rs.values_as_text(values, "rRMSE (%)", as_table=True, with_average=True))


@query("a42_training_preview", views.with_views("""
SELECT feature, round(min(v), 6) AS low, round(max(v), 6) AS high, round(corr(v, target), 6) AS direct_r FROM (
  SELECT filename, target, grp, is_aug, f0, f1, f2, f3 FROM data) UNPIVOT (v FOR feature IN (f0, f1, f2, f3))
WHERE NOT is_aug AND grp NOT IN (SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY md5(concat('3:', grp))) AS rn, n FROM pl) WHERE rn <= ceil(0.25e0 * n)) GROUP BY feature""",
    "v_dataset", ctes=DATA_FOLDS_CTE))
def training_preview(spark, sf_dir):
    return rounded_all(rs.training_preview(labelled(spark, sf_dir), ["f0", "f1", "f2", "f3"], 0.25, 3, include_aug=False))
