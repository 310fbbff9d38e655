"""Queries over fold-wise preparation, model fitting, search, importance and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotspark.functions.rng import inner_seed
from plotspark.models import cv, importance
from plotspark.models import design as ds
from plotspark.models.gram import Trial
from plotspark.models.registry import MODELS
from plotspark.operators import folds as fd
from plotspark.operators import metrics as mt
from plotspark.operators import results as rs
from plotspark.plans import views
from plotspark.plans.registry import query, rounded, rounded_all
from plotspark.plans.result_queries import DATA_FOLDS_CTE, labelled, metrics_sql

c = F.col

FEATURES = ("f0", "f1", "f2", "f3")


def _sided(spark, sf_dir, features=FEATURES, holes: bool = False, train_aug: bool = True):
    data = views.dataset(spark, sf_dir)
    if holes:
        data = data.withColumn("f2", F.when((c("plot") * 5 + c("aug")) % 7 != 0, c("f2"))).withColumn("f9", F.lit(None).cast("double"))
    rows = ds.labelled_rows(data, features, "target")
    return ds.with_folds(rows, fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25), 4, train_aug)


@query("f06_fit_and_score_rows", views.with_views("""
SELECT cycle, filename, NOT held_out AND aug = 0 AS fit, held_out AS scored FROM sided""", "v_dataset", ctes=DATA_FOLDS_CTE))
def fit_and_score_rows(spark, sf_dir):
    return _sided(spark, sf_dir, train_aug=False).select("cycle", "filename", "fit", c("held_out").alias("scored"))


@query("f08_m17_importance_subset", views.with_views("""
SELECT 'held_out' AS score_on, filename FROM sided WHERE cycle = 1 AND held_out AND aug = 0 UNION ALL
SELECT 'train', filename FROM sided WHERE cycle = 1 AND NOT held_out UNION ALL SELECT 'all', filename FROM data""", "v_dataset", ctes=DATA_FOLDS_CTE))
def importance_subset(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    held = fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25).where(c("cycle") == 1)
    out = None
    for score_on in ("held_out", "train", "all"):
        chosen, _ = importance.subset_rows(rows, held, score_on, importance.include_augmented(score_on, train_aug=True, score_aug=False))
        part = chosen.select(F.lit(score_on).alias("score_on"), "filename")
        out = part if out is None else out.unionByName(part)
    return out


HOLES_CTE = DATA_FOLDS_CTE.rstrip() + """,
holes AS (SELECT cycle, filename, held_out, f0, f1, CASE WHEN (plot * 5 + aug) % 7 <> 0 THEN f2 END AS f2, f3, target FROM sided),
med AS (SELECT cycle, median(f0) AS m0, median(f2) AS m2 FROM holes WHERE NOT held_out GROUP BY cycle)
"""


@query("m01_fold_medians", views.with_views("SELECT cycle, round(m0, 8) AS m0, round(m2, 8) AS m2, 0e0 AS m9 FROM med", "v_dataset", ctes=HOLES_CTE))
def fold_medians(spark, sf_dir):
    med = ds.medians(_sided(spark, sf_dir, ("f0", "f2", "f9"), holes=True), ("f0", "f2", "f9"), ["cycle"])
    return med.select("cycle", *[rounded(F.get("med", F.lit(i)), 8).alias(n) for i, n in enumerate(("m0", "m2", "m9"))])


@query("m01_m02_prepared_features", views.with_views("""
SELECT cycle, filename, round((f0 - avg(f0) FILTER (WHERE NOT held_out) OVER w) / stddev_pop(f0) FILTER (WHERE NOT held_out) OVER w, 6) + 0e0 AS z0,
       round(f2 - avg(f2) FILTER (WHERE NOT held_out) OVER w, 6) + 0e0 AS z2, 0e0 AS z9
FROM (SELECT cycle, filename, held_out, f0, coalesce(f2, m2) AS f2 FROM holes JOIN med USING (cycle)) WINDOW w AS (PARTITION BY cycle)""", "v_dataset", ctes=HOLES_CTE))
def prepared_features(spark, sf_dir):
    features = ("f0", "f2", "f9")
    sided = _sided(spark, sf_dir, features, holes=True)
    prep = ds.fit_prep(sided, features, ["cycle"], 4, normalize=["f0", "f9"])
    rows = ds.design_rows(sided, prep, features, ["cycle"], 4, cache=False)
    return rows.select("cycle", "filename", *[rounded(F.get("x", F.lit(i))).alias(n) for i, n in enumerate(("z0", "z2", "z9"))])


# One standardised feature: all linear models have a closed form.
ONE_CTE = DATA_FOLDS_CTE.rstrip() + """,
st AS (SELECT cycle, avg(f0) AS m, stddev_pop(f0) AS s, avg(target) AS ym, count(*) AS n FROM sided WHERE NOT held_out GROUP BY cycle),
z AS (SELECT d.cycle, filename, plot, aug, is_aug, held_out, target AS y, (f0 - m) / s AS x, ym, n FROM sided d JOIN st USING (cycle)),
one AS (SELECT cycle, any_value(n) AS n, sum(x * (y - ym)) AS sxy, sum(x * x) AS sxx FROM z WHERE NOT held_out GROUP BY cycle)
"""
TWO_CTE = DATA_FOLDS_CTE.rstrip() + """,
st AS (SELECT cycle, avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1, avg(target) AS ym, count(*) AS n FROM sided WHERE NOT held_out GROUP BY cycle),
z AS (SELECT d.cycle, filename, plot, aug, is_aug, held_out, target AS y, (f0 - m0) / s0 AS x0, (f1 - m1) / s1 AS x1, ym FROM sided d JOIN st USING (cycle)),
gr AS (SELECT cycle, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS d, sum(x0 * (y - ym)) AS p, sum(x1 * (y - ym)) AS q FROM z WHERE NOT held_out GROUP BY cycle),
wt AS (SELECT cycle, (p * (d + 1) - q * b) / ((a + 1) * (d + 1) - b * b) AS w0, (q * (a + 1) - p * b) / ((a + 1) * (d + 1) - b * b) AS w1 FROM gr),
pred AS (SELECT cycle + 1 AS split, filename, plot, aug, is_aug, held_out, y AS actual, ym + w0 * x0 + w1 * x1 AS predicted FROM z JOIN wt USING (cycle))
"""
RIDGE = cv.Procedure("ridge", ("f0", "f1"))


def _run(spark, sf_dir, proc):
    return cv.run_procedure(views.dataset(spark, sf_dir), proc)


def _predictions(run):
    return run.predictions.select("split", "filename", "held_out", rounded("predicted").alias("predicted"))


@query("m03_ridge", views.with_views("SELECT CAST(split AS INT) AS split, filename, held_out, round(predicted, 6) AS predicted FROM pred", "v_dataset", ctes=TWO_CTE))
def ridge(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, RIDGE))


@query("m04_lasso", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(ym + sign(sxy) * greatest(abs(sxy / z.n) - 0.5e0, 0) / (sxx / z.n) * x, 6) AS predicted FROM z JOIN one USING (cycle)""",
    "v_dataset", ctes=ONE_CTE))
def lasso(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("lasso", ("f0",), params={"alpha": 0.5})))


@query("m04_elastic_net", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(ym + sign(sxy) * greatest(abs(sxy / z.n) - 0.1e0, 0) / (sxx / z.n + 0.1e0) * x, 6) AS predicted FROM z JOIN one USING (cycle)""",
    "v_dataset", ctes=ONE_CTE))
def elastic_net(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("elastic_net", ("f0",), params={"alpha": 0.2, "l1_ratio": 0.5})))


def _four_cte(source: str, keys: str, kept: str, name: str = "four") -> str:
    """Standardised f0 to f3 of every fold of ``source`` (keys, held, y and the features) as {name}_z, and the fold's means of products as {name}_gr."""
    each = range(4)
    pairs = [(i, j) for i in each for j in range(i, 4)]
    return f"""
{name}_st AS (SELECT {keys}, {", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in each)}, avg(y) AS ym FROM {source} WHERE NOT held GROUP BY {keys}),
{name}_z AS (SELECT {keys}, {kept}, held, y, ym, {", ".join(f"(f{i} - m{i}) / s{i} AS x{i}" for i in each)} FROM {source} JOIN {name}_st USING ({keys})),
{name}_gr AS (SELECT {keys}, {", ".join(f"avg(x{i} * x{j}) AS g{i}{j}" for i, j in pairs)}, {", ".join(f"avg(x{i} * (y - ym)) AS p{i}" for i in each)} FROM {name}_z WHERE NOT held GROUP BY {keys})"""


def _descent_cte(keys: str, trials: str, sweeps: int, name: str = "four") -> str:
    """Weights of the elastic net by coordinate descent: ``sweeps`` rounds over the four weights. ``trials``: a table (trial, alpha, l1)."""
    def weight(i: int) -> str:
        rest = " + ".join(f"g{min(i, j)}{max(i, j)} * {'u' if j < i else 'k.w'}{j}" for j in range(4) if j != i)
        return f"sign(p{i} - ({rest})) * greatest(abs(p{i} - ({rest})) - alpha * l1, 0) / (g{i}{i} + alpha * (1 - l1)) AS u{i}"

    on = ", ".join(f"k.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_descent AS (
  SELECT {keys}, trial, 0 AS sweep, 0e0 AS w0, 0e0 AS w1, 0e0 AS w2, 0e0 AS w3 FROM {name}_gr CROSS JOIN {trials}
  UNION ALL SELECT {on}, k.trial, sweep + 1, {", ".join(weight(i) for i in range(4))} FROM {name}_descent k JOIN {name}_gr USING ({keys}) JOIN {trials} t ON t.trial = k.trial WHERE sweep < {sweeps}),
{name}_fits AS (SELECT * FROM {name}_descent WHERE sweep = {sweeps})"""


FOUR_CTE = DATA_FOLDS_CTE.rstrip() + ",\nsides AS (SELECT cycle, filename, held_out AS held, target AS y, f0, f1, f2, f3 FROM sided)," + _four_cte("sides", "cycle", "filename")


@query("m04_lasso_four_features", "WITH RECURSIVE" + views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held AS held_out, round(ym + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3, 6) AS predicted FROM four_z JOIN four_fits USING (cycle)""",
    "v_dataset", ctes=FOUR_CTE + ",\none_trial AS (SELECT 0 AS trial, 0.05e0 AS alpha, 1e0 AS l1)," + _descent_cte("cycle", "one_trial", 300)).removeprefix("WITH"))
def lasso_four_features(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("lasso", FEATURES, params={"alpha": 0.05})))


@query("m05_pls_one_component", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(ym + (p * x0 + q * x1) * (p * p + q * q) / (a * p * p + 2 * b * p * q + d * q * q), 6) AS predicted FROM z JOIN gr USING (cycle)""",
    "v_dataset", ctes=TWO_CTE))
def pls_one_component(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("pls", ("f0", "f1"), params={"n_components": 1})))


_G = "[" + ", ".join("[" + ", ".join(f"g{min(i, j)}{max(i, j)}" for j in range(4)) + "]" for i in range(4)) + "]"
_TIMES = "list_transform([1, 2, 3, 4], lambda i: list_dot_product(g[i], {0}))"
_PLUS = "list_transform([1, 2, 3, 4], lambda i: {0})"


@query("m05_pls_two_components", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held AS held_out, round(ym + list_dot_product(b, [x0, x1, x2, x3]), 6) AS predicted FROM four_z JOIN fit USING (cycle)""", "v_dataset", ctes=FOUR_CTE + f""",
c0 AS (SELECT cycle, {_G} AS g, [p0, p1, p2, p3] AS s FROM four_gr),
c1 AS (SELECT *, {_PLUS.format("s[i] / sqrt(list_dot_product(s, s))")} AS v1 FROM c0),
c2 AS (SELECT *, {_TIMES.format("v1")} AS gv1 FROM c1),
c3 AS (SELECT *, list_dot_product(v1, gv1) AS t1, list_dot_product(s, v1) AS r1 FROM c2),
c4 AS (SELECT *, {_PLUS.format("s[i] - gv1[i] / t1 * r1")} AS s2 FROM c3),
c5 AS (SELECT *, {_PLUS.format("s2[i] / sqrt(list_dot_product(s2, s2))")} AS v2 FROM c4),
c6 AS (SELECT *, list_dot_product(gv1, v2) / t1 AS pv, {_TIMES.format("v2")} AS gv2 FROM c5),
c7 AS (SELECT *, list_dot_product(s2, v2) / (list_dot_product(v2, gv2) - pv * pv * t1) AS q2 FROM c6),
fit AS (SELECT cycle, {_PLUS.format("v1[i] * (r1 / t1 - pv * q2) + v2[i] * q2")} AS b FROM c7)"""))
def pls_two_components(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("pls", FEATURES, params={"n_components": 2})))


@query("m05_pls_full_rank", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(ym + (p * d - q * b) / (a * d - b * b) * x0 + (q * a - p * b) / (a * d - b * b) * x1, 6) AS predicted FROM z JOIN gr USING (cycle)""",
    "v_dataset", ctes=TWO_CTE))
def pls_full_rank(spark, sf_dir):
    """As many components as features: least squares."""
    return _predictions(_run(spark, sf_dir, cv.Procedure("pls", ("f0", "f1"), params={"n_components": 2})))


KNN_CTE = DATA_FOLDS_CTE.rstrip() + """,
st AS (SELECT cycle, avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f2) AS m2, stddev_pop(f2) AS s2, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM sided WHERE NOT held_out GROUP BY cycle),
z AS (SELECT d.cycle, filename, held_out, target AS y, (f0 - m0) / s0 AS x0, (f1 - m1) / s1 AS x1, (f2 - m2) / s2 AS x2, (f3 - m3) / s3 AS x3 FROM sided d JOIN st USING (cycle)),
near AS (SELECT a.cycle, a.filename, a.held_out, b.y, sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2) + pow(a.x3 - b.x3, 2)) AS dist, b.filename AS other
         FROM z a JOIN z b ON a.cycle = b.cycle AND NOT b.held_out),
top AS (SELECT *, row_number() OVER (PARTITION BY cycle, filename ORDER BY dist, other) AS rk FROM near)
"""


@query("m06_k04_knn", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, any_value(held_out) AS held_out,
       round(CASE WHEN min(dist) = 0 THEN avg(y) FILTER (WHERE dist = 0) ELSE sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END, 6) AS predicted
FROM top WHERE rk <= 5 GROUP BY cycle, filename""", "v_dataset", ctes=KNN_CTE))
def knn_distance(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("knn", FEATURES)))


@query("m06_knn_uniform", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, any_value(held_out) AS held_out, round(avg(y), 6) AS predicted FROM top WHERE rk <= 7 GROUP BY cycle, filename""", "v_dataset", ctes=KNN_CTE))
def knn_uniform(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("knn", FEATURES, params={"n_neighbors": 7, "weights": "uniform"})))


ALL_DIMS = 64
ALL_NAMES = tuple(f"f{i}" for i in range(ALL_DIMS))
WIDE_CTE = "v_dataset AS (" + views.SQL_VIEWS["v_dataset"].replace("AS target", "AS target, embedding") + "),\n" + DATA_FOLDS_CTE.strip() + f""",
long AS (SELECT cycle, filename, held_out, target AS y, i, CAST(embedding[i] AS DOUBLE) AS v FROM sided CROSS JOIN range(1, {ALL_DIMS + 1}) AS r(i)),
sts AS (SELECT cycle, i, avg(v) AS m, stddev_pop(v) AS s FROM long WHERE NOT held_out GROUP BY cycle, i),
wide AS (SELECT cycle, filename, any_value(held_out) AS held_out, any_value(y) AS y, list((v - m) / s ORDER BY i) AS x FROM long JOIN sts USING (cycle, i) GROUP BY cycle, filename),
near AS (SELECT a.cycle, a.filename, a.held_out, b.y, list_distance(a.x, b.x) AS dist, b.filename AS other FROM wide a JOIN wide b ON a.cycle = b.cycle AND NOT b.held_out),
top AS (SELECT *, row_number() OVER (PARTITION BY cycle, filename ORDER BY dist, other) AS rk FROM near)
"""


@query("m06_knn_all_dimensions", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, any_value(held_out) AS held_out, round(avg(y), 6) AS predicted FROM top WHERE rk <= 7 GROUP BY cycle, filename""", ctes=WIDE_CTE))
def knn_all_dimensions(spark, sf_dir):
    """Nearest neighbours over the whole embedding."""
    return _predictions(cv.run_procedure(views.dataset(spark, sf_dir, ALL_DIMS), cv.Procedure("knn", ALL_NAMES, params={"n_neighbors": 7, "weights": "uniform"})))


@query("m07_random_forest")
def random_forest(spark, sf_dir):
    """300 trees of any depth a fold, over the whole embedding."""
    return _predictions(cv.run_procedure(views.dataset(spark, sf_dir, ALL_DIMS), cv.Procedure("random_forest", ALL_NAMES)))


@query("m07_boosted_trees")
def boosted_trees(spark, sf_dir):
    """200 rounds a fold, over the whole embedding."""
    return _predictions(cv.run_procedure(views.dataset(spark, sf_dir, ALL_DIMS), cv.Procedure("hist_gbt", ALL_NAMES)))


STUMP_L2, STUMP_LEAST = 2.0, 30


def _few_valued(data):
    return data.withColumns({f: F.floor(c(f) * 4) for f in FEATURES}).withColumn("target", F.floor("target"))


@query("m07_boosted_round", views.with_views(f"""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(ym + 0.5e0 * CASE WHEN long.v <= cut THEN s / (n + {STUMP_L2!r}) ELSE (-s) / (rows_ - n + {STUMP_L2!r}) END, 6) AS predicted
FROM long JOIN best USING (cycle, feature)""", "v_dataset", ctes=DATA_FOLDS_CTE.rstrip() + f""",
few AS (SELECT cycle, filename, held_out, floor(target) AS y, avg(floor(target)) FILTER (WHERE NOT held_out) OVER (PARTITION BY cycle) AS ym, {", ".join(f"floor(f{i} * 4) AS f{i}" for i in range(4))} FROM sided),
long AS (SELECT cycle, filename, held_out, y, ym, feature, v FROM few UNPIVOT (v FOR feature IN (f0, f1, f2, f3))),
cells AS (SELECT cycle, feature, v, count(*) AS k, sum(y - ym) AS sy FROM long WHERE NOT held_out GROUP BY cycle, feature, v),
runs AS (SELECT cycle, feature, v, (v + lead(v) OVER w) / 2 AS cut, sum(k) OVER w AS n, sum(sy) OVER w AS s, sum(k) OVER (PARTITION BY cycle, feature) AS rows_ FROM cells WINDOW w AS (PARTITION BY cycle, feature ORDER BY v)),
best AS (SELECT * FROM runs WHERE cut IS NOT NULL AND n >= {STUMP_LEAST} AND rows_ - n >= {STUMP_LEAST}
         QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY round(s * s / (n + {STUMP_L2!r}) + s * s / (rows_ - n + {STUMP_L2!r}), 4) DESC, feature, cut) = 1)
"""))
def boosted_round(spark, sf_dir):
    """One round of depth 1 with an L2 term and a least leaf size, over features of few values."""
    params = {"max_iter": 1, "max_depth": 1, "learning_rate": 0.5, "l2_regularization": STUMP_L2, "min_samples_leaf": STUMP_LEAST}
    return _predictions(cv.run_procedure(_few_valued(views.dataset(spark, sf_dir)), cv.Procedure("hist_gbt", FEATURES, params=params)))


@query("m08_gaussian_process")
def gaussian_process(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("gpr", FEATURES, params={"length_scale": 3.0})))


@query("m09_support_vectors")
def support_vectors(spark, sf_dir):
    """The default kernel over the whole embedding."""
    return _predictions(cv.run_procedure(views.dataset(spark, sf_dir, ALL_DIMS), cv.Procedure("svr", ALL_NAMES)))


@query("m09_linear_objective", "WITH RECURSIVE" + views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, round(objective, 2) AS objective FROM zoom WHERE step = 26""", "v_dataset", ctes=ONE_CTE.rstrip() + """,
zoom AS (
  SELECT DISTINCT cycle, 0 AS step, 0e0 AS w, 0e0 AS b, 64e0 AS h, 0e0 AS objective FROM z
  UNION ALL SELECT cycle, step + 1, arg_min(w, o), arg_min(b, o), any_value(h) / 2, min(o) FROM (
    SELECT cycle, step, h, w, b, pow(w, 2) / (2 * 10 * count(*)) + avg(greatest(abs(y - ym - w * x - b) - 0.1e0, 0)) AS o FROM (
      SELECT k.cycle, k.step, k.h, k.w + i * k.h / 5 AS w, k.b + j * k.h / 5 AS b, y, ym, x FROM zoom k CROSS JOIN range(-5, 6) AS p(i) CROSS JOIN range(-5, 6) AS q(j) JOIN z ON z.cycle = k.cycle AND NOT held_out WHERE step < 26)
    GROUP BY cycle, step, h, w, b) GROUP BY cycle, step)""").removeprefix("WITH"))
def linear_objective(spark, sf_dir):
    """What a linear fit of one feature reaches, against a search of all weights and intercepts."""
    run = _run(spark, sf_dir, cv.Procedure("svr", ("f0",), params={"kernel": "linear"}))
    loss = F.avg(F.greatest(F.abs(c("actual") - c("predicted")) - 0.1, F.lit(0.0)))
    losses = run.predictions.where("fit").groupBy("split").agg(loss.alias("loss"), F.count(F.lit(1)).alias("n"))
    weights = run.coefs.select((c("cycle") + 1).alias("split"), F.get("w", F.lit(0)).alias("w"))
    return losses.join(weights, "split").select(c("split").cast("int").alias("split"), rounded(c("w") * c("w") / (2 * 10 * c("n")) + c("loss"), 2).alias("objective"))


@query("m10_log_target", views.with_views("""
SELECT CAST(cycle + 1 AS INT) AS split, filename, held_out, round(greatest(exp(zh) * smear - 1, 0), 6) AS predicted
FROM fitted JOIN (SELECT cycle, avg(exp(ly - zh)) AS smear FROM fitted WHERE NOT held_out GROUP BY cycle) USING (cycle)""", "v_dataset", ctes=DATA_FOLDS_CTE.rstrip() + """,
st AS (SELECT cycle, avg(f0) AS m, stddev_pop(f0) AS s, avg(ln(1 + target)) AS ym FROM sided WHERE NOT held_out GROUP BY cycle),
z AS (SELECT d.cycle, filename, held_out, ln(1 + target) AS ly, (f0 - m) / s AS x, ym FROM sided d JOIN st USING (cycle)),
one AS (SELECT cycle, sum(x * (ly - ym)) / (sum(x * x) + 1) AS w FROM z WHERE NOT held_out GROUP BY cycle),
fitted AS (SELECT cycle, filename, held_out, ly, ym + w * x AS zh FROM z JOIN one USING (cycle))"""))
def log_target(spark, sf_dir):
    return _predictions(_run(spark, sf_dir, cv.Procedure("ridge", ("f0",), transform="log")))


@query("m11_fold_metrics", views.with_views(f"""
SELECT CAST(split AS INT) AS split, scope, {metrics_sql()} FROM (
  SELECT *, CASE WHEN held_out AND aug = 0 THEN 'held_out' WHEN NOT held_out THEN 'train' END AS scope FROM pred) WHERE scope IS NOT NULL GROUP BY split, scope""", "v_dataset", ctes=TWO_CTE))
def fold_metrics(spark, sf_dir):
    return rounded_all(cv.fold_metrics(_run(spark, sf_dir, RIDGE)))


@query("m11_fold_cube", views.with_views(f"""
SELECT CAST(split AS INT) AS split, scope, variant, {metrics_sql()} FROM pred JOIN (VALUES ('held_out', 'orig_only', false, false, true, false), ('held_out', 'with_aug', false, false, true, true),
  ('train', 'orig_only', true, false, false, false), ('train', 'with_aug', true, true, false, false), ('overall', 'orig_orig', true, false, true, false), ('overall', 'orig_aug', true, false, true, true),
  ('overall', 'aug_orig', true, true, true, false), ('overall', 'aug_aug', true, true, true, true)) AS t(scope, variant, use_t, aug_t, use_v, aug_v)
  ON (NOT held_out AND use_t AND (aug_t OR aug = 0)) OR (held_out AND use_v AND (aug_v OR aug = 0)) GROUP BY split, scope, variant""", "v_dataset", ctes=TWO_CTE))
def fold_cube(spark, sf_dir):
    return rounded_all(cv.fold_cube(_run(spark, sf_dir, RIDGE)))


@query("m12_nested_cv_summary", views.with_views(f"""
SELECT 'ridge' AS model, count(*) AS n_splits, round(avg(rrmse), 6) AS mean_rrmse, round(stddev_pop(rrmse), 6) AS std_rrmse, CAST(min_by(split, struct_pack(a := rrmse, b := split)) AS INT) AS best_split
FROM (SELECT split, {metrics_sql(digits=None)} FROM pred WHERE held_out AND aug = 0 GROUP BY split)""", "v_dataset", ctes=TWO_CTE))
def nested_cv_summary(spark, sf_dir):
    return rounded_all(cv.summary(_run(spark, sf_dir, RIDGE)))


ALPHAS = (0.01, 1.0, 30.0, 400.0)
SEARCH_CTE = DATA_FOLDS_CTE.rstrip() + """,
inner_pl AS (SELECT o.outer_, grp, row_number() OVER (PARTITION BY o.outer_ ORDER BY num) AS rn, count(*) OVER (PARTITION BY o.outer_) AS n
             FROM (SELECT DISTINCT grp, CAST(substr(grp, 6) AS INT) AS num FROM data) g CROSS JOIN (SELECT CAST(i AS INT) AS outer_ FROM range(4) AS r(i)) o
             JOIN folds f USING (grp) WHERE f.fold <> o.outer_),
inner_folds AS (SELECT outer_, grp, (rn - 1) // greatest(1, least(n, CAST(round_even(0.25e0 * n, 0) AS BIGINT), n // 3)) AS inner_fold FROM inner_pl),
rows_ AS (SELECT f.outer_, CAST(k AS INT) AS inner_, d.filename, d.aug, d.target AS y, d.f0, f.inner_fold = k AS held FROM data d JOIN inner_folds f USING (grp) CROSS JOIN range(3) AS r(k)),
st AS (SELECT outer_, inner_, avg(f0) AS m, stddev_pop(f0) AS s, avg(y) AS ym FROM rows_ WHERE NOT held GROUP BY outer_, inner_),
z AS (SELECT r.*, (f0 - m) / s AS x, ym FROM rows_ r JOIN st USING (outer_, inner_)),
cross_ AS (SELECT outer_, inner_, sum(x * x) AS sxx, sum(x * (y - ym)) AS sxy FROM z WHERE NOT held GROUP BY outer_, inner_),
trials AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {a}e0)" for i, a in enumerate(ALPHAS)) + """) AS t(trial, alpha)),
per_fold AS (SELECT outer_, trial, inner_, """ + metrics_sql("y", "p", None) + """ FROM (
  SELECT outer_, inner_, trial, y, ym + sxy / (sxx + alpha) * x AS p FROM z JOIN cross_ USING (outer_, inner_) CROSS JOIN trials WHERE held AND aug = 0) GROUP BY outer_, trial, inner_),
scores AS (SELECT outer_, trial, avg(rrmse) AS mean_rrmse, avg(r2) AS mean_r2, avg(r) AS mean_r, avg(mape) AS mean_mape, count(*) AS n_folds FROM per_fold GROUP BY outer_, trial)
"""


def _scores(spark, sf_dir):
    proc = cv.Procedure("ridge", ("f0",), test_size=0.25)
    data = views.dataset(spark, sf_dir)
    rows = labelled(spark, sf_dir, ("f0",))
    outer = fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25).persist()
    trials = [Trial(i, "ridge", {"alpha": a}) for i, a in enumerate(ALPHAS)]
    return cv.score_trials(data, proc, trials, 3, "sequential", outer, 4)


@query("m13_trial_scores", views.with_views("""
SELECT CAST(outer_ AS INT) AS "outer", CAST(trial AS INT) AS trial, round(mean_rrmse, 6) AS mean_rrmse, round(mean_r2, 6) AS mean_r2, round(mean_r, 6) AS mean_r, round(mean_mape, 6) AS mean_mape, n_folds FROM scores""",
    "v_dataset", ctes=SEARCH_CTE))
def trial_scores(spark, sf_dir):
    return rounded_all(_scores(spark, sf_dir))


@query("m13_inner_folds", views.with_views("""
SELECT CAST(outer_ AS INT) AS "outer", CAST(inner_fold AS INT) AS cycle, grp, 'sequential' AS mode FROM inner_folds WHERE inner_fold < 3
UNION ALL SELECT CAST(outer_ AS INT), CAST((rn - 1) % 3 AS INT), grp, 'systematic' FROM inner_pl WHERE (rn - 1) // 3 < greatest(1, least(n, CAST(round_even(0.25e0 * n, 0) AS BIGINT), n // 3))
UNION ALL SELECT CAST(outer_ AS INT), CAST((rh - 1) // greatest(1, least(n, CAST(round_even(0.25e0 * n, 0) AS BIGINT), n // 3)) AS INT), grp, 'random_systematic' FROM (
  SELECT *, row_number() OVER (PARTITION BY outer_ ORDER BY md5(concat(CAST(outer_ + 40 AS VARCHAR), ':', grp))) AS rh FROM inner_pl)
  WHERE (rh - 1) // greatest(1, least(n, CAST(round_even(0.25e0 * n, 0) AS BIGINT), n // 3)) < 3
UNION ALL SELECT CAST(outer_ AS INT), CAST(i AS INT), grp, 'random' FROM (
  SELECT *, row_number() OVER (PARTITION BY outer_, i ORDER BY md5(concat(CAST(i + outer_ + 40 AS VARCHAR), ':', grp))) AS rh FROM inner_pl CROSS JOIN range(3) AS r(i)) WHERE rh <= ceil(0.25e0 * n)""",
    "v_dataset", ctes=SEARCH_CTE))
def inner_folds(spark, sf_dir):
    rows = labelled(spark, sf_dir, ("f0",))
    outer = fd.grouped_folds(fd.groups_of(rows), "sequential", 4, 0.25)
    groups = rows.select("grp").distinct().withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(3))))
    groups = groups.join(outer.select(c("cycle").alias("outer"), "grp"), ["outer", "grp"], "left_anti").persist()
    out = None
    for mode in fd.MODES:
        part = fd.folds_per_key(groups, "outer", mode, 3, 0.25, c("outer") + 40).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("m13_best_trials", views.with_views("""
SELECT CAST(outer_ AS INT) AS "outer", CAST(min_by(trial, struct_pack(a := mean_rrmse, b := trial)) AS INT) AS trial, round(min(mean_rrmse), 6) AS mean_rrmse, round(min_by(mean_r2, struct_pack(a := mean_rrmse, b := trial)), 6) AS mean_r2,
       any_value(n_folds) AS n_folds FROM scores GROUP BY outer_""", "v_dataset", ctes=SEARCH_CTE))
def best_trials(spark, sf_dir):
    return rounded_all(cv.best_trials(_scores(spark, sf_dir)))


TUNED = cv.Procedure("elastic_net", FEATURES, params={"max_iter": 5000})
TUNED_CTE = "".join([
    SEARCH_CTE[: SEARCH_CTE.index("rows_ AS")], """
rows4 AS (SELECT f.outer_, CAST(k AS INT) AS inner_, d.filename, d.aug, d.target AS y, d.f0, d.f1, d.f2, d.f3, f.inner_fold = k AS held FROM data d JOIN inner_folds f USING (grp) CROSS JOIN range(3) AS r(k)),
drawn AS (SELECT * FROM (VALUES """, ", ".join(f"({t.trial}, CAST({t.params['alpha']!r} AS DOUBLE), CAST({t.params['l1_ratio']!r} AS DOUBLE))" for t in cv.draw_trials(TUNED, 4)),
    ") AS t(trial, alpha, l1)),", _four_cte("rows4", "outer_, inner_", "aug", "inn"), ",", _descent_cte("outer_, inner_", "drawn", 300, "inn"), """,
tried AS (SELECT outer_, trial, inner_, """, metrics_sql("y", "p", None), """ FROM (
  SELECT outer_, inner_, trial, y, ym + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 AS p FROM inn_z JOIN inn_fits USING (outer_, inner_) WHERE held AND aug = 0) GROUP BY outer_, trial, inner_),
means AS (SELECT outer_, trial, avg(rrmse) AS mean_rrmse FROM tried GROUP BY outer_, trial),
won AS (SELECT outer_, min_by(trial, struct_pack(a := mean_rrmse, b := trial)) AS trial FROM means WHERE isfinite(mean_rrmse) GROUP BY outer_),
sides AS (SELECT cycle, aug, held_out AS held, target AS y, f0, f1, f2, f3 FROM sided),""", _four_cte("sides", "cycle", "aug", "out"), ",", _descent_cte("cycle", "drawn", 300, "out"), """,
refit AS (SELECT f.cycle, alpha, y, ym + w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 AS p, CASE WHEN held AND aug = 0 THEN 'held_out' WHEN NOT held THEN 'train' END AS scope
          FROM out_z f JOIN won ON won.outer_ = f.cycle JOIN out_fits o ON o.cycle = f.cycle AND o.trial = won.trial JOIN drawn ON drawn.trial = won.trial)"""])


@query("m13_nested_search", "WITH RECURSIVE" + views.with_views(f"""
SELECT CAST(cycle + 1 AS INT) AS split, scope, {metrics_sql("y", "p")}, round(any_value(alpha), 6) AS alpha FROM refit WHERE scope IS NOT NULL GROUP BY cycle, scope""", "v_dataset", ctes=TUNED_CTE).removeprefix("WITH"))
def nested_search(spark, sf_dir):
    """Two parameters tuned on each outer fold's own training groups, over four features."""
    run, params = cv.nested_search(views.dataset(spark, sf_dir), TUNED, n_trials=4, inner_splits=3)
    return rounded_all(cv.fold_metrics(run).join(params.where(c("param") == "alpha").select("split", c("value").alias("alpha")), "split"))


NESTED = cv.Procedure("ridge", ("f0",))
DRAWN = [t.params["alpha"] for t in cv.draw_trials(NESTED, 4)]
NESTED_CTE = SEARCH_CTE.replace(", ".join(f"({i}, {a}e0)" for i, a in enumerate(ALPHAS)), ", ".join(f"({i}, CAST({a!r} AS DOUBLE))" for i, a in enumerate(DRAWN))).rstrip() + """,
picked AS (SELECT outer_, min_by(trial, struct_pack(a := mean_rrmse, b := trial)) AS trial FROM scores WHERE isfinite(mean_rrmse) GROUP BY outer_),
outer_st AS (SELECT cycle, avg(f0) AS m, stddev_pop(f0) AS s, avg(target) AS ym FROM sided WHERE NOT held_out GROUP BY cycle),
outer_z AS (SELECT d.cycle, held_out, aug, target AS y, (f0 - m) / s AS x, ym FROM sided d JOIN outer_st USING (cycle)),
outer_fit AS (SELECT cycle, sum(x * x) AS sxx, sum(x * (y - ym)) AS sxy FROM outer_z WHERE NOT held_out GROUP BY cycle),
outer_pred AS (SELECT z.cycle, alpha, y, ym + sxy / (sxx + alpha) * x AS p, CASE WHEN held_out AND aug = 0 THEN 'held_out' WHEN NOT held_out THEN 'train' END AS scope
               FROM outer_z z JOIN outer_fit USING (cycle) JOIN picked ON picked.outer_ = z.cycle JOIN trials USING (trial))
"""


@query("m13_nested_ridge", views.with_views(f"""
SELECT CAST(cycle + 1 AS INT) AS split, scope, {metrics_sql("y", "p")}, round(any_value(alpha), 6) AS alpha FROM outer_pred WHERE scope IS NOT NULL GROUP BY cycle, scope""", "v_dataset", ctes=NESTED_CTE))
def nested_ridge(spark, sf_dir):
    """Tuned on each outer fold's own training groups, refitted with the winner, scored on the untouched block."""
    run, params = cv.nested_search(views.dataset(spark, sf_dir), NESTED, n_trials=4, inner_splits=3)
    return rounded_all(cv.fold_metrics(run).join(params.where(c("param") == "alpha").select("split", c("value").alias("alpha")), "split"))


@query("m15_model_sweep", views.with_views(f"""
SELECT *, row_number() OVER (ORDER BY rrmse, model) AS place FROM (
  SELECT model, round(avg(rrmse) FILTER (WHERE scope = 'held_out'), 6) AS rrmse, round(avg(r2) FILTER (WHERE scope = 'held_out'), 6) AS r2, round(avg(r) FILTER (WHERE scope = 'held_out'), 6) AS r,
         round(avg(mape) FILTER (WHERE scope = 'held_out'), 6) AS mape, round(avg(rrmse) FILTER (WHERE scope = 'train'), 6) AS train_rrmse FROM (
    SELECT model, cycle, scope, {metrics_sql("y", "p", None)} FROM (
      SELECT model, cycle, y, p, CASE WHEN held_out AND aug = 0 THEN 'held_out' WHEN NOT held_out THEN 'train' END AS scope FROM (
        SELECT 'ridge' AS model, cycle, held_out, aug, y, ym + sxy / (sxx + 1) * x AS p FROM z JOIN one USING (cycle)
        UNION ALL SELECT 'pls', cycle, held_out, aug, y, ym + sxy / sxx * x FROM z JOIN one USING (cycle)
        UNION ALL SELECT 'lasso', cycle, held_out, aug, y, ym + sign(sxy) * greatest(abs(sxy / z.n) - 1, 0) / (sxx / z.n) * x FROM z JOIN one USING (cycle)
        UNION ALL SELECT 'elastic_net', cycle, held_out, aug, y, ym + sign(sxy) * greatest(abs(sxy / z.n) - 0.5e0, 0) / (sxx / z.n + 0.5e0) * x FROM z JOIN one USING (cycle)))
    WHERE scope IS NOT NULL GROUP BY model, cycle, scope) GROUP BY model)""", "v_dataset", ctes=ONE_CTE))
def model_sweep(spark, sf_dir):
    metrics, failed = cv.sweep(views.dataset(spark, sf_dir), cv.Procedure("ridge", ("f0",)), ["ridge", "pls", "lasso", "elastic_net"])
    if failed:
        raise RuntimeError(str(failed))
    return rounded_all(cv.rank_models(metrics)).withColumn("place", c("place").cast("bigint"))


@query("m15_full_sweep")
def full_sweep(spark, sf_dir):
    """All nine models with their defaults over the whole embedding."""
    metrics, failed = cv.sweep(views.dataset(spark, sf_dir, ALL_DIMS), cv.Procedure("ridge", ALL_NAMES), list(MODELS))
    if failed:
        raise RuntimeError(str(failed))
    return rounded_all(cv.rank_models(metrics)).withColumn("place", c("place").cast("bigint"))


REPEATS = importance.DEFAULT_REPEATS


def _network_sql(number: str) -> str:
    """SQL of one pass of the keyed network over ``number`` (bits, mask and the keys k0 to k3 in scope) as a subquery of ``steps``."""
    low = "4294967295::UBIGINT"
    query_ = f"SELECT *, CAST({number} AS UBIGINT) >> bits AS h0, CAST({number} AS UBIGINT) & mask AS l0 FROM steps"
    for k in range(importance.ROUNDS):
        first = f"((((l{k} + k{k}) & {low}) * {importance.MIXERS[0]}::UBIGINT) & {low})"
        second = f"((xor({first}, {first} >> 15) * {importance.MIXERS[1]}::UBIGINT) & {low})"
        query_ = f"SELECT *, l{k} AS h{k + 1}, xor(h{k}, xor({second}, {second} >> 13) & mask) AS l{k + 1} FROM ({query_})"
    return f"SELECT i, rep, n, bits, mask, {', '.join(f'k{k}' for k in range(importance.ROUNDS))}, (h{importance.ROUNDS} << bits) | l{importance.ROUNDS} AS pos FROM ({query_})"


KEYS_SQL = ", ".join("(" + ", ".join([str(r), *[f"{k}::UBIGINT" for k in keys]]) + ")" for r, keys in enumerate(importance.round_keys(9, REPEATS)))
IMPORTANCE_CTE = TWO_CTE.rstrip() + f""",
scored AS (SELECT z.filename, x0, x1, w0, w1, y AS actual, ym + w0 * x0 + w1 * x1 AS predicted, row_number() OVER (ORDER BY md5(concat('9:row:', z.filename))) - 1 AS i
           FROM z JOIN wt USING (cycle) WHERE cycle = 1 AND held_out),
sized AS (SELECT count(*)::UBIGINT AS n, (SELECT min(k) FROM range(1, 32) AS t(k) WHERE pow(4, k) >= (SELECT count(*) FROM scored))::INT AS b FROM scored),
starts AS (SELECT i, rep, n, b::UBIGINT AS bits, (1::UBIGINT << b) - 1 AS mask, k0, k1, k2, k3, i::UBIGINT AS pos, false AS moved FROM scored CROSS JOIN sized CROSS JOIN (VALUES {KEYS_SQL}) AS v(rep, k0, k1, k2, k3)),
walk AS (SELECT * FROM starts UNION ALL SELECT *, true FROM ({_network_sql("pos").replace("FROM steps", "FROM walk WHERE NOT moved OR pos >= n")})),
donors AS (SELECT i, rep, pos FROM walk WHERE moved AND pos < n)
"""


@query("m16_permutation_importance", "WITH RECURSIVE" + views.with_views("""
SELECT feature, round(avg(loss - base), 6) AS mean, round(stddev_pop(loss - base), 6) AS std, round(any_value(base), 6) AS baseline, any_value(n) AS n_scored FROM (
  SELECT feature, rep, sqrt(avg(pow(actual - p, 2))) / abs(avg(actual)) * 100 AS loss FROM (
    SELECT f.feature, t.rep, s.actual, s.predicted + CASE f.feature WHEN 'f0' THEN s.w0 * (d.x0 - s.x0) ELSE s.w1 * (d.x1 - s.x1) END AS p
    FROM scored s JOIN donors t ON t.i = s.i JOIN scored d ON d.i = t.pos CROSS JOIN (VALUES ('f0'), ('f1')) AS f(feature)) GROUP BY feature, rep)
CROSS JOIN (SELECT sqrt(avg(pow(actual - predicted, 2))) / abs(avg(actual)) * 100 AS base, count(*) AS n FROM scored) GROUP BY feature""", "v_dataset", ctes=IMPORTANCE_CTE).removeprefix("WITH"))
def permutation_importance(spark, sf_dir):
    run = _run(spark, sf_dir, RIDGE)
    features = list(RIDGE.features)
    rows = ds.labelled_rows(views.dataset(spark, sf_dir), features, "target").withColumnRenamed("y", "actual")
    held = rows.join(run.folds.where(c("cycle") == 1).select("grp"), "grp", "left_semi")
    return rounded_all(importance.permutation_importance(held, features, cv.scorer(cv.stored_tables(run), 2), REPEATS, seed=9))


@query("m16_forest_importance")
def forest_importance(spark, sf_dir):
    """Importance of every dimension of the embedding for a forest of full size, on the rows that its second fold holds out."""
    data = views.dataset(spark, sf_dir, ALL_DIMS)
    run = cv.run_procedure(data, cv.Procedure("random_forest", ALL_NAMES))
    rows = ds.labelled_rows(data, ALL_NAMES, "target").withColumnRenamed("y", "actual")
    held = rows.join(run.folds.where(c("cycle") == 1).select("grp"), "grp", "left_semi")
    return rounded_all(importance.permutation_importance(held, ALL_NAMES, cv.scorer(cv.stored_tables(run), 2), REPEATS, seed=9))


@query("m18_score_stored_model", views.with_views("""
SELECT d.filename, round(d.target, 6) AS actual, round(ym + w0 * (d.f0 + 0.01e0 - m0) / s0 + w1 * (d.f1 - m1) / s1, 6) AS predicted, CASE WHEN f.fold = 2 THEN 'V' ELSE 'T' END AS role
FROM data d JOIN folds f USING (grp) CROSS JOIN (SELECT * FROM st JOIN wt USING (cycle) WHERE cycle = 2)""", "v_dataset", ctes=TWO_CTE))
def score_stored_model(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    run = cv.run_procedure(data, RIDGE)
    shifted = data.withColumn("f0", c("f0") + 0.01)
    table = cv.score_dataset(shifted, cv.fitted_table(run), RIDGE.features, "target", split=3)
    train = table.select("grp").distinct().join(run.folds.where(c("cycle") == 2).select("grp"), "grp", "left_anti")
    return rounded_all(rs.plot_table(table, train, "grp").select("filename", "actual", "predicted", "role"))


def _stored_again(spark, sf_dir, proc):
    """The stored model's predictions next to the run's own, for the rows of one fold."""
    data = views.dataset(spark, sf_dir, ALL_DIMS)
    run = cv.run_procedure(data, proc)
    own = run.predictions.where(c("split") == 2).select("filename", c("predicted").alias("own"))
    stored = cv.score_stored(data, cv.stored_tables(run), "target", 2)
    return stored.join(own, "filename").select("filename", rounded("predicted").alias("predicted"), rounded("own").alias("own"))


@query("m18_stored_forest")
def stored_forest(spark, sf_dir):
    return _stored_again(spark, sf_dir, cv.Procedure("random_forest", ALL_NAMES))


STORED_KNN_SQL = views.with_views("""
SELECT filename, round(avg(y), 6) AS predicted, round(avg(y), 6) AS own FROM top WHERE rk <= 7 AND cycle = 1 GROUP BY filename""", ctes=WIDE_CTE)


@query("m18_stored_neighbours", STORED_KNN_SQL)
def stored_neighbours(spark, sf_dir):
    return _stored_again(spark, sf_dir, cv.Procedure("knn", ALL_NAMES, params={"n_neighbors": 7, "weights": "uniform"}))


@query("g10_inner_seeds", views.with_views("SELECT split, CAST(('0x' || substr(md5(concat('7:cycle:', CAST(split AS VARCHAR))), 1, 7)) AS BIGINT) AS seed FROM (SELECT DISTINCT split FROM v_predictions)", "v_predictions"))
def inner_seeds(spark, sf_dir):
    return views.predictions(spark, sf_dir).select("split").distinct().select("split", inner_seed(7, c("split")).alias("seed"))
