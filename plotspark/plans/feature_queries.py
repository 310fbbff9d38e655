"""Queries over point tables: the per-cloud features and the statistics behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotspark.operators import features as ft
from plotspark.plans import views
from plotspark.plans.registry import query, rounded, rounded_all

c = F.col

# ---- shared pieces of the checker's SQL: moments, axes, levels of every cloud
BASE_CTE = """
veg AS (SELECT * FROM v_points WHERE classification = 1),
cloud AS (SELECT filename, count(*) AS n, avg(height) AS ha, min(height) AS hlo, max(height) AS hhi, var_samp(height) AS hv,
                 avg(x) AS xa, avg(y) AS ya, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b,
                 covar_samp(x, height) AS xh, covar_samp(y, height) AS yh,
                 quantile_cont(height, 0.05) AS cut_lo, quantile_cont(height, 0.95) AS cut_hi
          FROM veg GROUP BY filename),
axes AS (SELECT *, greatest((a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b), 0) AS l1,
                greatest((a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b), 0) AS l2,
                CASE WHEN b = 0 AND a = d THEN 0 ELSE cos(0.5 * atan2(2 * b, a - d)) END AS ux,
                CASE WHEN b = 0 AND a = d THEN 1 ELSE sin(0.5 * atan2(2 * b, a - d)) END AS uy
         FROM cloud),
proj AS (SELECT v.*, k.n, k.ha, k.hv, k.a, k.b, k.d, k.xh, k.yh, k.l1, k.l2, k.cut_lo, k.cut_hi, k.xa, k.ya, k.ux, k.uy,
                v.x - k.xa AS dx, v.y - k.ya AS dy,
                (v.x - k.xa) * k.ux + (v.y - k.ya) * k.uy AS s1, -(v.x - k.xa) * k.uy + (v.y - k.ya) * k.ux AS s2
         FROM veg v JOIN axes k USING (filename))
"""


def _features(keys, digits: int = 6):
    def plan(spark, sf_dir):
        return rounded_all(ft.compute_features(views.points(spark, sf_dir), keys), digits)
    return plan


query("a01_height_center", views.with_views(
    "SELECT filename, round(avg(height), 10) AS h_mean, round(max(height), 10) AS h_max FROM v_points WHERE classification = 1 GROUP BY filename",
    "v_points"))(_features(["h_mean", "h_max"], 10))

query("a02_height_percentiles", views.with_views("""
SELECT filename, round(quantile_cont(height, 0.5), 9) AS h_median, round(quantile_cont(height, 0.25), 9) AS h_p25,
       round(quantile_cont(height, 0.75), 9) AS h_p75, round(quantile_cont(height, 0.95), 9) AS h_p95
FROM v_points WHERE classification = 1 GROUP BY filename""", "v_points"))(_features(["h_median", "h_p25", "h_p75", "h_p95"], 9))

query("a03_a04_height_spread", views.with_views("""
SELECT filename, round(CASE WHEN count(*) >= 2 THEN var_samp(height) END, 6) AS h_var,
       round(CASE WHEN count(*) >= 2 THEN stddev_samp(height) END, 6) AS h_std,
       round(CASE WHEN count(*) >= 2 AND avg(height) > 0 THEN stddev_samp(height) / avg(height) END, 6) AS h_cv
FROM v_points WHERE classification = 1 GROUP BY filename""", "v_points"))(_features(["h_var", "h_std", "h_cv"]))

query("a05_a06_height_shape", views.with_views("""
SELECT filename, round(CASE WHEN count(*) >= 3 AND avg(d2) > 0 THEN avg(d3) / pow(avg(d2), 1.5) END, 6) AS h_skew,
       round(CASE WHEN count(*) >= 4 AND avg(d2) > 0 THEN avg(d4) / pow(avg(d2), 2) - 3 END, 6) AS h_kurtosis
FROM dev GROUP BY filename""", "v_points", ctes="""
mean AS (SELECT filename, avg(height) AS m FROM v_points WHERE classification = 1 GROUP BY filename),
dev AS (SELECT v.filename, pow(height - m, 2) AS d2, pow(height - m, 3) AS d3, pow(height - m, 4) AS d4
        FROM v_points v JOIN mean USING (filename) WHERE classification = 1)"""))(_features(["h_skew", "h_kurtosis"]))

query("a07_height_entropy", views.with_views("""
SELECT filename, round(-sum(p * log2(p)), 6) + 0e0 AS entropy FROM (
  SELECT filename, k * 1e0 / sum(k) OVER (PARTITION BY filename) AS p
  FROM (SELECT filename, layer, count(*) AS k FROM binned WHERE h <= lo + (edges - 1) * step GROUP BY ALL))
GROUP BY filename""", "v_points", ctes="""
ext AS (SELECT filename, floor(least(0e0, min(height))) AS lo, max(height) AS hi FROM v_points WHERE classification = 1 GROUP BY filename),
grid AS (SELECT filename, lo, (lo + 0.1e0) - lo AS step, ceil((hi + 0.1e0 - lo) / 0.1e0) AS edges FROM ext),
idx AS (SELECT v.filename, v.height AS h, lo, step, edges, floor((v.height - lo) / step) AS k
        FROM v_points v JOIN grid USING (filename) WHERE classification = 1),
binned AS (SELECT *, least(CASE WHEN h < lo + k * step THEN k - 1 WHEN h >= lo + (k + 1) * step THEN k + 1 ELSE k END, edges - 2) AS layer
           FROM idx WHERE edges >= 2)"""))(_features(["entropy"]))

query("a08_surface_roughness", views.with_views("""
SELECT filename, round(CASE WHEN max(n) >= 3 THEN sqrt(avg(res * res)) END, 6) AS sigma_z FROM (
  SELECT filename, n, (height - ha) - (xh * d - yh * b) / (a * d - b * b) * dx - (yh * a - xh * b) / (a * d - b * b) * dy AS res FROM proj)
GROUP BY filename""", "v_points", ctes=BASE_CTE))(_features(["sigma_z"]))

query("a09_share_above_mean", views.with_views("""
SELECT filename, round(avg(CASE WHEN height > m THEN 1e0 ELSE 0e0 END), 6) AS frac_above_mean
FROM (SELECT filename, height, avg(height) OVER (PARTITION BY filename) AS m FROM v_points WHERE classification = 1) GROUP BY filename""",
    "v_points"))(_features(["frac_above_mean"]))

query("a10_penetration_ratio", views.with_views("""
SELECT filename, round(count(*) FILTER (WHERE classification = 2) / CAST(count(*) AS DOUBLE), 6) AS ppr FROM v_points GROUP BY filename""",
    "v_points"))(_features(["ppr"]))

query("a11_colour_means", views.with_views("""
SELECT filename, round(avg(red), 6) AS "R_mean", round(avg(green), 6) AS "G_mean", round(avg(blue), 6) AS "B_mean"
FROM v_points WHERE classification = 1 GROUP BY filename""", "v_points"))(_features(["R_mean", "G_mean", "B_mean"]))

query("a12_a13_axis_spread", views.with_views("""
SELECT filename, round(sqrt(l1), 6) AS pca_spread_major, round(sqrt(l2), 6) AS pca_spread_minor,
       round((sqrt(l1) - sqrt(l2)) / nullif(sqrt(l1) + sqrt(l2), 0), 6) AS pca_anisotropy
FROM axes""", "v_points", ctes=BASE_CTE))(_features(["pca_spread_major", "pca_spread_minor", "pca_anisotropy"]))

query("a14_axis_asymmetry", views.with_views("""
SELECT filename, round(abs(sum(sign(s1))) / sum(abs(sign(s1))), 6) AS asym_major, round(abs(sum(sign(s2))) / sum(abs(sign(s2))), 6) AS asym_minor
FROM proj GROUP BY filename""", "v_points", ctes=BASE_CTE))(_features(["asym_major", "asym_minor"]))

query("a15_slope_angles", views.with_views("""
SELECT filename,
       round(abs(degrees(atan(regr_slope(height, s1) FILTER (WHERE height >= cut_hi)) - atan(regr_slope(height, s1) FILTER (WHERE height <= cut_lo)))), 6) AS slope_angle_major,
       round(abs(degrees(atan(regr_slope(height, s2) FILTER (WHERE height >= cut_hi)) - atan(regr_slope(height, s2) FILTER (WHERE height <= cut_lo)))), 6) AS slope_angle_minor
FROM proj GROUP BY filename""", "v_points", ctes=BASE_CTE))(_features(["slope_angle_major", "slope_angle_minor"]))

query("a16_axis_roughness", views.with_views("""
SELECT filename, round(sqrt(avg(pow((height - ha) - k1 * s1, 2))), 6) AS rough_major, round(sqrt(avg(pow((height - ha) - k2 * s2, 2))), 6) AS rough_minor
FROM (SELECT *, (ux * xh + uy * yh) / l1 AS k1, (-uy * xh + ux * yh) / l2 AS k2 FROM proj) GROUP BY filename""",
    "v_points", ctes=BASE_CTE))(_features(["rough_major", "rough_minor"]))
