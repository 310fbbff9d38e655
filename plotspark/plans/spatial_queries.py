"""Queries over geometry: clipping, footprints, grids, layouts, residuals, label remapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotspark.functions import scalars
from plotspark.operators import features as ft
from plotspark.operators import spatial as sp
from plotspark.plans import views
from plotspark.plans.feature_queries import BASE_CTE
from plotspark.plans.registry import query, rounded, rounded_all

c = F.col

INSIDE_CTE = """
edges AS (SELECT a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v_mask_vertices a JOIN v_mask_vertices b ON a.label = b.label AND b.seq = a.seq % 4 + 1),
box AS (SELECT label, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy FROM v_mask_vertices GROUP BY label),
hits AS (SELECT p.filename, p.point_id, e.label,
                sum(CASE WHEN (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS crossed,
                sum(CASE WHEN (x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) = 0 AND p.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) AS touched
         FROM v_points p JOIN box b ON p.x BETWEEN b.minx AND b.maxx AND p.y BETWEEN b.miny AND b.maxy JOIN edges e ON e.label = b.label GROUP BY p.filename, p.point_id, e.label),
inside AS (SELECT h.label, p.* FROM hits h JOIN v_points p USING (filename, point_id) WHERE crossed % 2 = 1 AND touched = 0)
"""


@query("j01_point_in_polygon", views.with_views("""
SELECT label, filename, point_id FROM inside""", "v_points", "v_mask_vertices", ctes=INSIDE_CTE))
def point_in_polygon(spark, sf_dir):
    return sp.points_in_masks(views.points(spark, sf_dir), views.masks(spark, sf_dir)).select("label", "filename", "point_id")


FIELD_CORNERS = ((1, -100.25), (2, -100.25), (3, 100.25), (4, 100.25)), ((1, -200.5), (2, 200.5), (3, 200.5), (4, -200.5))


@query("j01_unequal_masks", views.with_views("""
SELECT label, count(*) AS points, round(avg(z), 6) AS mean_z FROM inside GROUP BY label""", "v_points", "v_mask_vertices", ctes="""
field AS (SELECT * FROM v_mask_vertices UNION ALL SELECT 1000, seq, x, y FROM (VALUES (1, -100.25e0, -200.5e0), (2, -100.25e0, 200.5e0), (3, 100.25e0, 200.5e0), (4, 100.25e0, -200.5e0)) AS f(seq, x, y)),
""" + INSIDE_CTE.replace("v_mask_vertices", "field").lstrip()))
def unequal_masks(spark, sf_dir):
    """One mask around the whole field beside the small ones."""
    from plotspark.sources.masks import masks_from_vertices

    corners = [(1000, seq, x, y) for (seq, x), (_, y) in zip(*FIELD_CORNERS, strict=True)]
    field = spark.createDataFrame(corners, "label int, seq int, x double, y double")
    shapes = masks_from_vertices(views.mask_vertices(spark, sf_dir).unionByName(field))
    found = sp.points_in_masks(views.points(spark, sf_dir), shapes)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("points"), rounded(F.avg("z")).alias("mean_z"))


@query("j01_clipped_plots", views.with_views("""
SELECT b.label, count(i.label) AS points, round(avg(z), 6) AS mean_z, count(i.label) = 0 AS empty FROM (SELECT DISTINCT label FROM v_mask_vertices) b LEFT JOIN inside i ON i.label = b.label GROUP BY b.label""",
    "v_points", "v_mask_vertices", ctes=INSIDE_CTE))
def clipped_plots(spark, sf_dir):
    shapes = views.masks(spark, sf_dir)
    clipped = sp.points_in_masks(views.points(spark, sf_dir), shapes)
    counts = clipped.groupBy("label").agg(F.count(F.lit(1)).alias("points"), rounded(F.avg("z")).alias("mean_z"), F.lit(False).alias("empty"))
    none = sp.empty_masks(shapes, clipped).select("label", F.lit(0).cast("bigint").alias("points"), F.lit(None).cast("double").alias("mean_z"), F.lit(True).alias("empty"))
    return counts.unionByName(none)


TRIM_CTE = """
band AS (SELECT filename, quantile_cont(x, 0.005) AS xlo, quantile_cont(x, 0.995) AS xhi, quantile_cont(y, 0.005) AS ylo, quantile_cont(y, 0.995) AS yhi, count(*) AS n FROM v_points GROUP BY filename),
flagged AS (SELECT p.*, n, x BETWEEN xlo AND xhi AND y BETWEEN ylo AND yhi AS inside FROM v_points p JOIN band USING (filename)),
trimmed AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE inside) OVER (PARTITION BY filename) AS kept FROM flagged) WHERE inside OR n < 20 OR kept < 3)
"""


@query("f07_outlier_trim", views.with_views("SELECT filename, point_id FROM trimmed", "v_points", ctes=TRIM_CTE))
def outlier_trim(spark, sf_dir):
    return sp.trim_outliers(views.points(spark, sf_dir), ["filename"]).select("filename", "point_id")


@query("a21_a22_grid_pitch", views.with_views("""
SELECT round(max(dx) * 0.3048e0, 8) AS span_x, round(max(dy) * 0.3048e0, 8) AS span_y, round(greatest(max(dx) * 0.3048e0, 1e-9) * 1.1e0, 8) AS pitch_x, round(greatest(max(dy) * 0.3048e0, 1e-9) * 1.1e0, 8) AS pitch_y
FROM (SELECT filename, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM v_points GROUP BY filename)""", "v_points"))
def grid_pitch(spark, sf_dir):
    spans = sp.largest_spans(views.points(spark, sf_dir), 0.3048)
    pitch = sp.grid_pitch(spans, 0.10)
    return rounded_all(spans.withColumn("pitch_x", pitch.select("pitch_x").scalar()).withColumn("pitch_y", pitch.select("pitch_y").scalar()), 8)


@query("a23_cloud_bounds", views.with_views("""
SELECT filename, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, round(max(y), 6) AS ymax, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, round(avg(z), 6) AS cz
FROM v_points GROUP BY filename""", "v_points"))
def cloud_bounds(spark, sf_dir):
    box = sp.bounds(views.points(spark, sf_dir), ["filename"])
    return box.select("filename", *[rounded(k, 9 if k in ("cx", "cy") else 6).alias(k) for k in box.columns if k != "filename"])


@query("a24_height_levels", views.with_views("""
SELECT filename, level, round(value, 10) AS value FROM (
  SELECT filename, avg(height) AS h_mean, quantile_cont(height, 0.5) AS h_median, quantile_cont(height, 0.25) AS h_p25, quantile_cont(height, 0.75) AS h_p75,
         quantile_cont(height, 0.95) AS h_p95, max(height) AS h_max FROM v_points WHERE classification = 1 GROUP BY filename)
UNPIVOT (value FOR level IN (h_mean, h_median, h_p25, h_p75, h_p95, h_max))""", "v_points"))
def height_levels(spark, sf_dir):
    levels = ["h_mean", "h_median", "h_p25", "h_p75", "h_p95", "h_max"]
    wide = ft.compute_features(views.points(spark, sf_dir), levels)
    return wide.unpivot("filename", levels, "level", "value").select("filename", "level", rounded("value", 10).alias("value"))


def _whole_steps(points):
    """Coordinates in whole steps of their resolution, so that every cross product is exact."""
    return points.withColumns({"x": F.round(c("x") * 10), "y": F.round(c("y") * 100)})


def _hull_ctes(source: str) -> str:
    """Hull vertices by wrapping: from the lowest point of the least x, always to the point of the least further turn, the farthest of those in line."""
    return f"""
steps AS (SELECT DISTINCT filename, x, y FROM {source}),
wrap AS (
  SELECT filename, 0 AS step, min(x) AS x, arg_min(y, (x, y)) AS y, min(x) AS x0, arg_min(y, (x, y)) AS y0, CAST(-pi() / 2 AS DOUBLE) AS turn, false AS closed FROM steps GROUP BY filename
  UNION ALL
  SELECT filename, step + 1, arg_min(px, (t, -far)), arg_min(py, (t, -far)), any_value(x0), any_value(y0), min(t), arg_min(px = x0 AND py = y0, (t, -far))
  FROM (SELECT w.*, s.x AS px, s.y AS py, pow(s.x - w.x, 2) + pow(s.y - w.y, 2) AS far, round(CASE WHEN atan2(s.y - w.y, s.x - w.x) >= turn - 1e-9 THEN atan2(s.y - w.y, s.x - w.x) ELSE atan2(s.y - w.y, s.x - w.x) + 2 * pi() END, 12) AS t
        FROM wrap w JOIN steps s ON s.filename = w.filename AND (s.x <> w.x OR s.y <> w.y) WHERE NOT closed)
  GROUP BY filename, step),
hulls AS (SELECT filename, step, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM wrap WHERE NOT closed WINDOW w AS (PARTITION BY filename ORDER BY step)),
sides AS (SELECT e.filename, e.step, (e.nx - e.x) / sqrt(pow(e.nx - e.x, 2) + pow(e.ny - e.y, 2)) AS ux, (e.ny - e.y) / sqrt(pow(e.nx - e.x, 2) + pow(e.ny - e.y, 2)) AS uy FROM hulls e),
boxes AS (SELECT s.filename, s.step, ux, uy, max(h.x * ux + h.y * uy) - min(h.x * ux + h.y * uy) AS a, max(h.y * ux - h.x * uy) - min(h.y * ux - h.x * uy) AS b FROM sides s JOIN hulls h USING (filename) GROUP BY s.filename, s.step, ux, uy),
least AS (SELECT * FROM boxes QUALIFY row_number() OVER (PARTITION BY filename ORDER BY round(a * b, 6), step) = 1)
"""


STEPS_CTE = "v_steps AS (SELECT * REPLACE (round(x * 10) AS x, round(y * 100) AS y) FROM v_points),"


def _wrapped_sql(body: str, source: str = "v_steps", more: str = "") -> str:
    return "WITH RECURSIVE" + views.with_views(body, "v_points", ctes=STEPS_CTE + more + _hull_ctes(source)).removeprefix("WITH")


@query("a25_convex_hulls", _wrapped_sql("SELECT filename, CAST(count(*) AS INT) AS vertices, round(sum(x * ny - nx * y) / 2, 6) AS area, string_agg(CAST(x AS BIGINT) || ' ' || CAST(y AS BIGINT), ', ' ORDER BY step) AS hull FROM hulls GROUP BY filename"))
def convex_hulls(spark, sf_dir):
    hulls = sp.convex_hulls(_whole_steps(views.points(spark, sf_dir)), ["filename"])
    following = F.concat(F.slice("hull", 2, F.size("hull")), F.slice("hull", 1, 1))
    doubled = F.aggregate(F.zip_with("hull", following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    corners = F.array_join(F.transform("hull", lambda v: F.concat_ws(" ", v["x"].cast("bigint"), v["y"].cast("bigint"))), ", ")
    return hulls.select("filename", F.size("hull").alias("vertices"), rounded(doubled / 2).alias("area"), corners.alias("hull"))


DIRECTIONS = ((1, 0), (2, 1), (1, 1), (1, 2), (0, 1), (-1, 2), (-1, 1), (-2, 1), (-1, 0), (-2, -1), (-1, -1), (-1, -2), (0, -1), (1, -2), (1, -1), (2, -1))


@query("a25_hull_extremes", views.with_views(
    "SELECT filename, " + ", ".join(f"round(max({a} * x + {b} * y), 6) + 0e0 AS e{i}" for i, (a, b) in enumerate(DIRECTIONS)) + " FROM v_points GROUP BY filename", "v_points"))
def hull_extremes(spark, sf_dir):
    """How far each hull reaches in sixteen directions: as far as the points themselves."""
    hulls = sp.convex_hulls(views.points(spark, sf_dir), ["filename"])
    reach = lambda a, b: F.array_max(F.transform("hull", lambda v: F.lit(float(a)) * v["x"] + F.lit(float(b)) * v["y"]))
    return hulls.select("filename", *[rounded(reach(a, b)).alias(f"e{i}") for i, (a, b) in enumerate(DIRECTIONS)])


@query("a26_min_area_boxes", _wrapped_sql("SELECT filename, round(least(a, b), 6) AS short_side, round(greatest(a, b), 6) AS long_side FROM least"))
def min_area_boxes(spark, sf_dir):
    boxes = sp.min_area_rectangles(sp.convex_hulls(_whole_steps(views.points(spark, sf_dir)), ["filename"]))
    short, long = scalars.box_sides(c("corners"))
    return boxes.select("filename", rounded(short).alias("short_side"), rounded(long).alias("long_side"))


FOOTPRINT_SQL = _wrapped_sql("""
SELECT filename, round(cx, 6) AS cx, round(cy, 6) AS cy, round(least(a, b), 6) AS short_side, round(greatest(a, b), 6) AS long_side,
       round(CASE WHEN angle > 90 THEN angle - 180 WHEN angle <= -90 THEN angle + 180 ELSE angle END, 6) + 0e0 AS angle
FROM (SELECT filename, a, b, CASE WHEN a >= b THEN degrees(atan2(uy, ux)) ELSE degrees(atan2(ux, -uy)) END AS angle FROM least)
JOIN (SELECT filename, avg(x) AS cx, avg(y) AS cy FROM v_steps GROUP BY filename) USING (filename)""", "trimmed", TRIM_CTE.replace("v_points", "v_steps").strip() + ",")


@query("a27_footprints", FOOTPRINT_SQL)
def footprints(spark, sf_dir):
    out = sp.footprints(_whole_steps(views.points(spark, sf_dir)), ["filename"])
    short, long = scalars.box_sides(c("corners"))
    return out.select("filename", rounded("cx").alias("cx"), rounded("cy").alias("cy"), rounded(short).alias("short_side"), rounded(long).alias("long_side"), rounded(scalars.box_angle(c("corners"))).alias("angle"))


@query("a33_slope_planes", views.with_views("""
SELECT filename, axis, stratum, round(slope, 6) AS slope, round(s0, 6) + 0e0 AS s0, round(h0, 6) AS h0 FROM (
  SELECT filename, 'major' AS axis, 'top' AS stratum, regr_slope(height, s1) AS slope, avg(s1) AS s0, avg(height) AS h0 FROM proj WHERE height >= cut_hi GROUP BY filename
  UNION ALL SELECT filename, 'major', 'bottom', regr_slope(height, s1), avg(s1), avg(height) FROM proj WHERE height <= cut_lo GROUP BY filename
  UNION ALL SELECT filename, 'minor', 'top', regr_slope(height, s2), avg(s2), avg(height) FROM proj WHERE height >= cut_hi GROUP BY filename
  UNION ALL SELECT filename, 'minor', 'bottom', regr_slope(height, s2), avg(s2), avg(height) FROM proj WHERE height <= cut_lo GROUP BY filename)""", "v_points", ctes=BASE_CTE))
def slope_planes(spark, sf_dir):
    return rounded_all(ft.slope_planes(views.points(spark, sf_dir)))


@query("j09_plane_residuals", views.with_views("""
SELECT filename, point_id, round(ha + pa * dx + pb * dy, 6) AS plane_h, round(height - ha - pa * dx - pb * dy, 6) + 0e0 AS residual FROM (
  SELECT v.filename, v.point_id, height, ha, x - xa AS dx, y - ya AS dy, (xh * d - yh * b) / (a * d - b * b) AS pa, (yh * a - xh * b) / (a * d - b * b) AS pb
  FROM v_points v JOIN (SELECT filename, avg(height) AS ha, avg(x) AS xa, avg(y) AS ya, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b, covar_samp(x, height) AS xh,
                               covar_samp(y, height) AS yh FROM v_points GROUP BY filename) USING (filename))""", "v_points"))
def plane_residuals(spark, sf_dir):
    return rounded_all(sp.residuals(views.points(spark, sf_dir)).select("filename", "point_id", "plane_h", "residual"))


CELLS_SQL = """
ent AS (SELECT filename, plot, CAST((row_number() OVER (ORDER BY plot) - 1) % 10 AS BIGINT) AS cc, (row_number() OVER (ORDER BY plot) - 1) // 10 AS rr FROM (SELECT DISTINCT filename, plot FROM v_points)),
mid AS (SELECT filename, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM v_points GROUP BY filename),
pitch AS (SELECT greatest(max(dx), 1e-9) * 1.1e0 AS px, greatest(max(dy), 1e-9) * 1.1e0 AS py FROM mid)
"""


@query("w08_field_cells", """
SELECT file_no, name, CAST(col - min(col) OVER () AS BIGINT) AS cell_col, CAST("row" - min("row") OVER () AS BIGINT) AS cell_row
FROM (SELECT p_partkey AS file_no, concat(CAST(p_size AS VARCHAR), '-', CAST(p_partkey % 18 + 1 AS VARCHAR), '-1-b.pcd') AS name, p_partkey % 18 + 1 AS col, p_size AS "row" FROM part)""")
def field_cells(spark, sf_dir):
    from plotspark.operators.keys import plan_import
    from plotspark.plans.naming_queries import GRID_NAMES

    return sp.grid_cells(plan_import(views.names(spark, sf_dir), "name", GRID_NAMES).entries).select("file_no", "name", "cell_col", "cell_row")


@query("w08_reading_order_cells", views.with_views("SELECT filename, cc AS cell_col, rr AS cell_row FROM ent", "v_points", ctes=CELLS_SQL))
def reading_order_cells(spark, sf_dir):
    return _cells(views.points(spark, sf_dir))


def _cells(points):
    entries = points.select("filename", c("plot").alias("number")).distinct().withColumn("row", F.lit(None).cast("int")).withColumn("col", c("number"))
    return sp.grid_cells(entries, 10).select("filename", "cell_col", "cell_row")


@query("w09_grid_placement", views.with_views("""
SELECT filename, point_id, round(x - mx + cc * px, 6) + 0e0 AS x, round(y - my - rr * py, 6) + 0e0 AS y, round(z, 8) AS z FROM v_points JOIN mid USING (filename) JOIN ent USING (filename) CROSS JOIN pitch""",
    "v_points", ctes=CELLS_SQL))
def grid_placement(spark, sf_dir):
    pts = views.points(spark, sf_dir)
    moved = sp.place_on_grid(pts, _cells(pts), sp.grid_pitch(sp.largest_spans(pts), 0.10))
    return moved.select("filename", "point_id", rounded("x").alias("x"), rounded("y").alias("y"), rounded("z", 8).alias("z"))


@query("g09_field_layout", views.with_views("""
SELECT CAST(base + i AS BIGINT) AS plot, CAST(CASE WHEN (i // rows) % 2 = 1 THEN i % rows ELSE rows - 1 - i % rows END AS BIGINT) AS "row", CAST(cols - 1 - i // rows AS BIGINT) AS col
FROM (SELECT base, rows, cols, unnest(range(rows * cols)) AS i FROM (SELECT base, rows, CAST(ceil(n / CAST(rows AS DOUBLE)) AS BIGINT) AS cols FROM (
  SELECT count(DISTINCT plot) AS n, CAST(ceil(sqrt(count(DISTINCT plot))) AS BIGINT) AS rows, min(plot) AS base FROM v_points)))""", "v_points"))
def field_layout(spark, sf_dir):
    grid = sp.auto_grid(views.points(spark, sf_dir)).first()
    return sp.field_layout(spark, grid["rows"], grid["cols"], grid["base"], start="bottom-right", major="column", snake=True)


@query("j07_label_remap", """
SELECT CASE WHEN p.n_nationkey IS NOT NULL THEN p.n_nationkey ELSE n.n_nationkey END AS label, coalesce(p.n_name, n.n_name) AS name, n.n_nationkey AS orig_label, n.n_name AS orig_name,
       p.n_nationkey IS NOT NULL AND p.n_nationkey <> n.n_nationkey AS moved, CAST(n.n_regionkey AS INT) AS geometry
FROM nation n LEFT JOIN nation p ON p.n_nationkey = CASE WHEN n.n_nationkey % 2 = 0 THEN n.n_nationkey + 1 ELSE n.n_nationkey - 1 END""")
def label_remap(spark, sf_dir):
    nations = views.table(spark, sf_dir, "nation").select(c("n_nationkey").alias("label"), c("n_name").alias("name"), c("n_regionkey").alias("geometry"))
    key = c("label")
    remap = nations.select("label", F.when(key % 2 == 0, key + 1).otherwise(key - 1).alias("partner"))
    return sp.remap_labels(nations, remap, ["name"])
