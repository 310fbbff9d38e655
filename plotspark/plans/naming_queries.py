"""Queries over names, labels, keys and reference sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotspark.functions import naming, scalars
from plotspark.functions.naming import KeyFormat, LabelFormat
from plotspark.operators import encode, keys, spatial
from plotspark.operators.ranking import ordered_rank
from plotspark.plans import views
from plotspark.plans.registry import query, rounded
from plotspark.sources import channels, listing, masks, reference

c = F.col

SUPPLIER = LabelFormat("Supplier#", "")
GRID_NAMES = KeyFormat(col=LabelFormat("-", "-1-b"), row=LabelFormat("", "-"))
PLOT_RE = r"(?i)plot\s*\(\s*(\d+)\s*\)"
AUG_RE = r"(?i)aug\s*\(\s*(\d+)\s*\)"

ALL_NAMES_SQL = "SELECT filename AS name FROM v_dataset UNION ALL SELECT name FROM v_names"


def _all_names(spark, sf_dir):
    return views.dataset(spark, sf_dir).select(c("filename").alias("name")).unionByName(views.names(spark, sf_dir).select("name"))


@query("p01_p02_name_numbers", views.with_views(rf"""
SELECT name, plot, aug, coalesce(aug, 0) AS aug_level, aug IS NOT NULL AS is_aug FROM (
  SELECT name, TRY_CAST(nullif(regexp_extract(name, '{PLOT_RE}', 1), '') AS INT) AS plot,
         TRY_CAST(nullif(regexp_extract(name, '{AUG_RE}', 1), '') AS INT) AS aug FROM ({ALL_NAMES_SQL}))""", "v_dataset", "v_names"))
def name_numbers(spark, sf_dir):
    name = c("name")
    return _all_names(spark, sf_dir).select(
        "name", naming.plot_number(name).alias("plot"), naming.aug_number(name).alias("aug"), naming.aug_level(name).alias("aug_level"),
        naming.aug_number(name).isNotNull().alias("is_aug"))


@query("p03_label_numbers", r"""
SELECT text, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)Supplier#\s*(-?\d+)\s*', 1), '') AS INT),
                      TRY_CAST(nullif(regexp_extract(text, '^\s*(-?\d+)(?:\.0+)?\s*$', 1), '') AS INT)) AS number
FROM (SELECT s_name AS text FROM supplier UNION ALL SELECT concat(' ', CAST(s_suppkey AS VARCHAR), '.0 ') FROM supplier
      UNION ALL SELECT concat(CAST(s_suppkey AS VARCHAR), '.5') FROM supplier UNION ALL SELECT c_name FROM customer)""")
def label_numbers(spark, sf_dir):
    supplier, customer = views.table(spark, sf_dir, "supplier"), views.table(spark, sf_dir, "customer")
    key = c("s_suppkey").cast("string")
    texts = (
        supplier.select(c("s_name").alias("text"))
        .unionByName(supplier.select(F.concat(F.lit(" "), key, F.lit(".0 ")).alias("text")))
        .unionByName(supplier.select(F.concat(key, F.lit(".5")).alias("text")))
        .unionByName(customer.select(c("c_name").alias("text"))))
    return texts.select("text", naming.label_number(c("text"), SUPPLIER).alias("number"))


NAME_KEYS_CTE = r"""
keyed AS (SELECT file_no, name, TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\.[^.]+$', ''), '(?i)-\s*(-?\d+)\s*-1-b', 1), '') AS INT) AS col,
                 TRY_CAST(nullif(regexp_extract(regexp_replace(name, '\.[^.]+$', ''), '(?i)\s*(-?\d+)\s*-', 1), '') AS INT) AS "row" FROM v_names),
entries AS (SELECT *, CAST("row" AS BIGINT) * (SELECT CAST(greatest(10, pow(10, length(CAST(max(col) AS VARCHAR)))) AS BIGINT) FROM keyed) + col AS number FROM keyed)
"""


@query("p04_p05_packed_keys", views.with_views('SELECT file_no, name, col, "row", number FROM entries', "v_names", ctes=NAME_KEYS_CTE))
def packed_keys(spark, sf_dir):
    return keys.plan_import(views.names(spark, sf_dir), "name", GRID_NAMES).entries.select("file_no", "name", "col", "row", "number")


@query("p06_built_names", views.with_views(r"""
SELECT filename, concat(regexp_replace(filename, '\.[^.]+$', ''), '_aug(', CAST(aug AS VARCHAR), ').las') AS aug_name,
       concat(regexp_replace(filename, '\.[^.]+$', ''), '.laz') AS copy_name, concat('plot(', CAST(plot AS VARCHAR), ')_siteA.laz') AS plot_name
FROM v_dataset""", "v_dataset"))
def built_names(spark, sf_dir):
    name = c("filename")
    return views.dataset(spark, sf_dir).select(
        "filename", naming.aug_name(name, c("aug"), ".las").alias("aug_name"), naming.copy_name(name).alias("copy_name"),
        naming.plot_name(c("plot"), "_siteA").alias("plot_name"))


@query("p07_group_order", views.with_views(r"""
SELECT grp, row_number() OVER (ORDER BY n IS NULL, n, grp) AS rank FROM (
  SELECT DISTINCT grp, TRY_CAST(nullif(regexp_extract(regexp_extract(grp, '([^:]*)$', 1), '^\s*([+-]?\d+)\s*$', 1), '') AS BIGINT) AS n
  FROM (SELECT coalesce(concat('plot:', nullif(regexp_extract(name, '(?i)plot\s*\(\s*(\d+)\s*\)', 1), '')), concat('row:', name)) AS grp
        FROM (SELECT name, nullif(regexp_extract(name, '(?i)plot\s*\(\s*(\d+)\s*\)', 1), '') IS NOT NULL AS has FROM (""" + ALL_NAMES_SQL + r""")) WHERE has
        UNION ALL SELECT concat('row:', name) FROM (""" + ALL_NAMES_SQL + r""") WHERE nullif(regexp_extract(name, '(?i)plot\s*\(\s*(\d+)\s*\)', 1), '') IS NULL))""",
    "v_dataset", "v_names"))
def group_order(spark, sf_dir):
    groups = _all_names(spark, sf_dir).select(naming.group_label(c("name")).alias("grp")).distinct()
    return ordered_rank(groups, naming.group_order(c("grp")))


UNIT_TEXTS = ("Already in metres", " millimetres -> METRES", "Centimetres→metres", "feet -> metres", "cubits")


@query("p08_unit_scaling", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Already in metres' WHEN 1 THEN 'Millimetres → metres' WHEN 2 THEN 'Centimetres → metres'
                                     WHEN 3 THEN 'Feet → metres' ELSE 'Already in metres' END AS unit,
       round(p_retailprice * CASE p_partkey % 5 WHEN 1 THEN 0.001e0 WHEN 2 THEN 0.01e0 WHEN 3 THEN 0.3048e0 ELSE 1e0 END, 8) AS scaled FROM part""")
def unit_scaling(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t in UNIT_TEXTS]), (c("p_partkey") % 5 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", scalars.unit_name(text).alias("unit"), rounded(c("p_retailprice") * scalars.unit_scale(text), 8).alias("scaled"))


@query("p09_height_channel", views.with_views("""
SELECT filename, round(avg(CASE WHEN plot % 10 <> 3 THEN height END), 6) AS mean_height, plot % 10 = 3 AS failed FROM v_points GROUP BY filename, plot""", "v_points"))
def height_channel(spark, sf_dir):
    pts = views.points(spark, sf_dir)
    extra = F.when(c("plot") % 10 == 3, F.create_map(F.lit("Amplitude"), c("z"))).otherwise(F.create_map(F.lit("RelativeHeight"), c("height")))
    pts = pts.withColumn("extra", extra).drop("height")
    failed = channels.missing_channel(pts, "RelativeHeight").select("filename", F.lit(True).alias("_f"))
    means = pts.groupBy("filename").agg(rounded(F.avg(channels.channel_value(pts, "RelativeHeight"))).alias("mean_height"))
    return means.join(failed, "filename", "left").select("filename", "mean_height", F.coalesce("_f", F.lit(False)).alias("failed"))


@query("p10_numeric_coercion", """
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN NULL ELSE round(p_retailprice, 6) END AS number FROM part""")
def numeric_coercion(spark, sf_dir):
    text = F.when(c("p_partkey") % 5 == 0, "n/a").when(c("p_partkey") % 5 == 1, "NaN").otherwise(c("p_retailprice").cast("string"))
    return views.table(spark, sf_dir, "part").select("p_partkey", rounded(scalars.numeric_or_null(text)).alias("number"))


@query("p11_p12_log_target", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS z, round(greatest(exp(ln(1 + o_totalprice)) * 1.05e0 - 1, 0), 6) AS back FROM orders""")
def log_target(spark, sf_dir):
    z = scalars.log_target(c("o_totalprice"))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", rounded(z).alias("z"), rounded(scalars.from_log_target(z, 1.05), 6).alias("back"))


@query("p14_balance_index", """
SELECT l_suppkey, round(CASE WHEN p + n > 0 THEN (p - n) / CAST(p + n AS DOUBLE) END, 8) AS balance
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 45) AS p, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 45) AS n
      FROM lineitem GROUP BY l_suppkey)""")
def balance(spark, sf_dir):
    many = c("l_quantity") > 45
    sides = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if((c("l_returnflag") == "R") & many).alias("p"), F.count_if((c("l_returnflag") == "A") & many).alias("n"))
    return sides.select("l_suppkey", rounded(scalars.balance_index(c("p"), c("n")), 8).alias("balance"))


@query("p16_box_geometry", views.with_views("""
SELECT label, round(least(e1, e2), 8) AS short_side, round(greatest(e1, e2), 8) AS long_side,
       round(CASE WHEN a > 90 THEN a - 180 WHEN a <= -90 THEN a + 180 ELSE a END, 8) + 0e0 AS angle
FROM (SELECT label, e1, e2, degrees(CASE WHEN e1 >= e2 THEN atan2(dy1, dx1) ELSE atan2(dy2, dx2) END) AS a FROM (
  SELECT *, sqrt(dx1 * dx1 + dy1 * dy1) AS e1, sqrt(dx2 * dx2 + dy2 * dy2) AS e2 FROM (
    SELECT label, x2 - x1 AS dx1, y2 - y1 AS dy1, x3 - x2 AS dx2, y3 - y2 AS dy2 FROM (
      SELECT label, max(x) FILTER (WHERE seq = 1) AS x1, max(y) FILTER (WHERE seq = 1) AS y1, max(x) FILTER (WHERE seq = 2) AS x2,
             max(y) FILTER (WHERE seq = 2) AS y2, max(x) FILTER (WHERE seq = 3) AS x3, max(y) FILTER (WHERE seq = 3) AS y3
      FROM v_mask_vertices GROUP BY label))))""", "v_mask_vertices"))
def box_geometry(spark, sf_dir):
    corners = views.masks(spark, sf_dir).select("label", F.slice(F.get("rings", F.lit(0)), 1, 4).alias("corners"))
    short, long = scalars.box_sides(c("corners"))
    return corners.select("label", rounded(short, 8).alias("short_side"), rounded(long, 8).alias("long_side"),
                          rounded(scalars.box_angle(c("corners")), 8).alias("angle"))


@query("p17_display_values", """
SELECT s_suppkey, CASE WHEN abs(v) >= 1000 OR (abs(v) < 0.01 AND v <> 0) THEN format('{:.2g}', v) ELSE format('{:.1f}', v) END AS raw, format('{:+.2f}', v / 1000) AS z,
       concat(format('{:.0f}', v / 10), '%') AS pct, CAST(s_suppkey AS VARCHAR) AS plot FROM (SELECT s_suppkey, s_acctbal / 7e0 AS v FROM supplier)""")
def display_values(spark, sf_dir):
    value = c("s_acctbal") / 7.0
    return views.table(spark, sf_dir, "supplier").select(
        "s_suppkey", scalars.display_value(value, "raw").alias("raw"), scalars.display_value(value / 1000, "z").alias("z"),
        scalars.display_value(value / 10, "percentile").alias("pct"),
        scalars.display_value(c("s_suppkey").cast("double"), "raw", is_plot=True).alias("plot"))


@query("p18_augmentation_flags", """
SELECT o_orderkey, CASE WHEN setting AND had = false THEN false ELSE setting END AS effective, cube AND coalesce(had, true) AS meaningful FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS setting,
         CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS had, o_orderkey % 2 = 0 AS cube FROM orders)""")
def augmentation_flags(spark, sf_dir):
    def flag(col):
        return F.when(c(col) % 3 == 0, True).when(c(col) % 3 == 1, False)
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.effective_aug(flag("o_orderkey"), flag("o_custkey")).alias("effective"),
        scalars.toggles_meaningful(c("o_orderkey") % 2 == 0, flag("o_custkey")).alias("meaningful"))


MODEL_KEYS = ("pls", "elastic_net", "lasso", "ridge", "knn", "svr", "random_forest", "hist_gbt", "gpr", "deep_set", "point_net")


@query("p19_model_labels", f"""
SELECT p_partkey, key AS model, coalesce(CASE key WHEN 'pls' THEN 'PLS' WHEN 'elastic_net' THEN 'Elastic' WHEN 'lasso' THEN 'Lasso' WHEN 'ridge' THEN 'Ridge'
         WHEN 'knn' THEN 'kNN' WHEN 'svr' THEN 'SVR' WHEN 'random_forest' THEN 'RF' WHEN 'hist_gbt' THEN 'HistGBT' WHEN 'gpr' THEN 'GPR' END,
       CASE key WHEN 'deep_set' THEN 'Deep Set' ELSE 'Point Net' END) AS label,
       concat('[ML] ', key, CASE WHEN p_size % 2 = 0 THEN ' (AUG)' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' (nested CV)' ELSE '' END, ' — ', p_type,
              ' (rRMSE ', format('{{:.3g}}', p_retailprice / 97e0), '%, 2024-05-01)') AS listed
FROM (SELECT *, [{', '.join(repr(k) for k in MODEL_KEYS)}][CAST(p_partkey % 11 AS INT) + 1] AS key FROM part)""")
def model_labels(spark, sf_dir):
    key = F.element_at(F.array(*[F.lit(k) for k in MODEL_KEYS]), (c("p_partkey") % 11 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").withColumn("model", key).select(
        "p_partkey", "model", scalars.model_abbreviation(c("model")).alias("label"),
        scalars.run_label(c("model"), c("p_size") % 2 == 0, c("p_size") % 3 == 0, c("p_type"), c("p_retailprice") / 97.0, F.lit("2024-05-01")).alias("listed"))


# --------------------------------------------------------------------------------- listings
EXTENSIONS = (".las", ".LAZ", ".pcd", ".txt")


@query("s01_natural_listing", """
SELECT path, row_number() OVER (ORDER BY p_size % 12, p_partkey) AS place FROM (
  SELECT p_size, p_partkey, concat('Run', CAST(p_size % 12 AS VARCHAR), '/plot', CAST(p_partkey AS VARCHAR), ['.las', '.LAZ', '.pcd', '.txt'][CAST(p_partkey % 4 AS INT) + 1]) AS path
  FROM part) WHERE p_partkey % 4 <> 3""")
def natural_listing(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (c("p_partkey") % 4 + 1).cast("int"))
    paths = views.table(spark, sf_dir, "part").select(F.concat(
        F.lit("Run"), (c("p_size") % 12).cast("string"), F.lit("/plot"), c("p_partkey").cast("string"), ext).alias("path"))
    return listing.natural_order(listing.importable(paths))


@query("s04_point_counts", views.with_views("""
SELECT count(*) AS clouds, CAST(sum(n) AS BIGINT) AS points, CAST(round_even(sum(n) / CAST(count(*) AS DOUBLE), 0) AS BIGINT) AS per_cloud
FROM (SELECT filename, count(*) AS n FROM v_points GROUP BY filename)""", "v_points"))
def point_counts(spark, sf_dir):
    return listing.point_summary(listing.point_counts(views.points(spark, sf_dir)))


@query("s04_dimension_listing", views.with_views("""
SELECT dimension, count(DISTINCT filename) AS clouds FROM (
  SELECT filename, unnest(['x', 'y', 'z', 'height', 'classification', 'red', 'green', 'blue', CASE WHEN plot % 2 = 0 THEN 'Amplitude' END]) AS dimension FROM v_points)
WHERE dimension IS NOT NULL GROUP BY dimension""", "v_points"))
def dimension_listing(spark, sf_dir):
    pts = views.points(spark, sf_dir).withColumn("extra", F.when(c("plot") % 2 == 0, F.create_map(F.lit("Amplitude"), c("z"))))
    return channels.channel_listing(pts)


@query("s05_polygon_scan", views.with_views("""
SELECT label, count(*) AS vertices, round(min(x), 8) AS minx, round(max(x), 8) AS maxx, round(min(y), 8) AS miny, round(max(y), 8) AS maxy
FROM v_mask_vertices WHERE label % 7 <> 3 AND label % 7 <> 5 GROUP BY label""", "v_mask_vertices"))
def polygon_scan(spark, sf_dir):
    ring = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.concat(
        F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))), ",")
    rings = views.mask_vertices(spark, sf_dir).groupBy("label").agg(ring.alias("ring"))
    shape = F.when(c("label") % 7 == 3, F.lit("null")).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":[['), c("ring"), F.lit("]]}")))
    text = F.when(c("label") % 7 == 5, F.lit("unknown")).otherwise(F.concat(F.lit("P_"), c("label").cast("string"), F.lit("_a")))
    lines = rings.select(F.concat(F.lit('{"type":"Feature","properties":{"plot_id":"'), text, F.lit('"},"geometry":'), shape, F.lit("}")).alias("value"))
    found, _ = masks.load_masks(masks.features_from_geojson(lines), "plot_id", LabelFormat("P_", "_a"))
    return found.select("label", (F.size(F.get("rings", F.lit(0))) - 1).cast("bigint").alias("vertices"),
                        *[rounded(n, 8).alias(n) for n in ("minx", "maxx", "miny", "maxy")])


@query("s06_reference_columns", views.with_views("""
SELECT unnest(['label', 'stage', 'block', 'biomass', 'row_no']) AS "column",
       unnest([count(label), count(stage), count(block), count(CASE WHEN block <> 4 THEN biomass END), count(row_no)]) AS filled FROM v_reference""", "v_reference"))
def reference_columns(spark, sf_dir):
    sheet = views.reference(spark, sf_dir).withColumn("biomass", F.when(c("block") == 4, F.lit(float("nan"))).otherwise(c("biomass")))
    sheet = sheet.withColumn("note", F.lit(None).cast("string")).withColumn("blank", F.lit(""))
    kept = reference.drop_blank_columns(sheet)
    return reference.filled_columns(kept)


@query("s09_import_manifest", views.with_views("""
SELECT number AS plot, concat('plot(', CAST(number AS VARCHAR), ')_siteA.laz') AS file, "row", col AS "column", name AS source_file FROM entries""",
    "v_names", ctes=NAME_KEYS_CTE))
def import_manifest(spark, sf_dir):
    from plotspark.sinks import import_manifest as rows

    return rows(keys.plan_import(views.names(spark, sf_dir), "name", GRID_NAMES), "name", "_siteA").select("plot", "file", "row", "column", "source_file")


@query("s11_file_map", views.with_views("""
SELECT plot, aug, min(path) AS path, min_by(filename, path) AS file FROM (
  SELECT plot, aug, filename, concat('b/', filename) AS path FROM v_dataset UNION ALL SELECT plot, aug, filename, concat('a/', filename) FROM v_dataset WHERE plot % 3 = 0)
GROUP BY plot, aug""", "v_dataset"))
def file_map(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    paths = (
        data.select(F.concat(F.lit("b/"), c("filename")).alias("path"))
        .unionByName(data.where(c("plot") % 3 == 0).select(F.concat(F.lit("a/"), c("filename")).alias("path")))
        .unionByName(data.select(F.concat(F.lit("a/"), c("filename"), F.lit(".txt")).alias("path"))))
    return listing.file_map(paths)


# ------------------------------------------------------------------------------- import plans
@query("a18_key_stride", views.with_views(
    "SELECT CAST(greatest(10, pow(10, length(CAST(max(col) AS VARCHAR)))) AS BIGINT) AS stride FROM keyed", "v_names", ctes=NAME_KEYS_CTE))
def key_stride(spark, sf_dir):
    return keys.plan_import(views.names(spark, sf_dir), "name", GRID_NAMES).stride


@query("a19_duplicate_identities", views.with_views("""
SELECT number, name, file_no, claims FROM (SELECT *, count(*) OVER (PARTITION BY number) AS claims FROM entries) WHERE claims > 1""", "v_names", ctes=NAME_KEYS_CTE))
def duplicate_identities(spark, sf_dir):
    return keys.plan_import(views.names(spark, sf_dir), "name", GRID_NAMES).duplicates.select("number", "name", "file_no", "claims")


@query("a20_surviving_files", views.with_views("SELECT number, max(file_no) AS file_no, max_by(name, file_no) AS name FROM entries GROUP BY number",
                                               "v_names", ctes=NAME_KEYS_CTE))
def surviving_files(spark, sf_dir):
    entries = keys.plan_import(views.names(spark, sf_dir), "name", GRID_NAMES).entries
    return keys.surviving_files(entries, "file_no").select("number", "file_no", "name")


@query("f09_unreadable_names", views.with_views(r"""
SELECT name, (SELECT count(*) FROM named WHERE col IS NOT NULL) AS entries, (SELECT count(DISTINCT col) FROM named) AS numbers, count(*) OVER () AS unreadable, false AS is_clean
FROM named WHERE col IS NULL""", "v_names", ctes=r"""
named AS (SELECT name, TRY_CAST(nullif(regexp_extract(name, '(?i)part\s*(-?\d+)\s*x', 1), '') AS INT) AS col
          FROM (SELECT CASE WHEN file_no % 9 = 4 THEN concat('scan_', name) ELSE concat('part', CAST(file_no % 500 AS VARCHAR), 'x.las') END AS name FROM v_names))"""))
def unreadable_names(spark, sf_dir):
    names = views.names(spark, sf_dir).select(F.when(c("file_no") % 9 == 4, F.concat(F.lit("scan_"), c("name"))).otherwise(
        F.concat(F.lit("part"), (c("file_no") % 500).cast("string"), F.lit("x.las"))).alias("name"))
    plan = keys.plan_import(names, "name", KeyFormat(col=LabelFormat("part", "x")))
    clean = plan.is_clean
    return plan.unreadable.select("name", *[clean.select(n).scalar().alias(n) for n in ("entries", "numbers", "unreadable", "is_clean")])


# -------------------------------------------------------------------------- reference sheets
SHEET_CTE = r"""
sheet AS (SELECT CAST(nullif(regexp_extract(label, '(?i)Supplier#\s*(-?\d+)\s*', 1), '') AS BIGINT) AS plot, stage, block, biomass, row_no FROM v_reference),
firsts AS (SELECT plot, min_by(stage, row_no) AS stage, min_by(block, row_no) AS block, min_by(biomass, row_no) AS biomass FROM sheet GROUP BY plot)
"""


def _sheet(spark, sf_dir):
    return keys.key_sheet(views.reference(spark, sf_dir), "label", SUPPLIER)


@query("f02_reference_row_filter", views.with_views("SELECT label, stage, block, round(biomass, 6) AS biomass, row_no FROM v_reference WHERE stage = 'Z65'", "v_reference"))
def reference_row_filter(spark, sf_dir):
    sheet = views.reference(spark, sf_dir).withColumn("stage", F.concat(F.lit("  "), "stage"))
    kept = encode.keep_rows(sheet, "stage", "Z65 ")
    return kept.select("label", F.trim("stage").alias("stage"), "block", rounded("biomass").alias("biomass"), "row_no")


@query("f03_column_values", views.with_views("SELECT DISTINCT CAST(block AS VARCHAR) AS value FROM v_reference", "v_reference"))
def column_values(spark, sf_dir):
    return encode.column_values(views.reference(spark, sf_dir), "block")


@query("f04_column_resolution", views.with_views("SELECT filename, f0, f2, f3 FROM v_dataset", "v_dataset"))
def column_resolution(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    return data.select("filename", *encode.resolve_columns(["f0", "f1", "f2", "f3"], disabled=["f1"]))


@query("j02_reference_lookup", views.with_views("""
SELECT filename, v.plot, stage, block, round(biomass, 6) AS biomass FROM (SELECT DISTINCT filename, plot FROM v_points) v LEFT JOIN firsts f ON f.plot = v.plot""",
    "v_points", "v_reference", ctes=SHEET_CTE))
def reference_lookup(spark, sf_dir):
    files = views.points(spark, sf_dir).select("filename", "plot").distinct()
    found = encode.lookup(files, _sheet(spark, sf_dir), ["stage", "block", "biomass"])
    return found.select("filename", "plot", "stage", "block", rounded("biomass").alias("biomass"))


@query("j03_paired_keys", """
SELECT plot, count(*) AS rows, round(avg(value), 6) AS mean_value FROM (
  SELECT run_no * (SELECT CAST(greatest(10, pow(10, length(CAST(max(p_partkey % 18 + 1) AS VARCHAR)))) AS BIGINT) FROM part) + range_no AS plot, value FROM (
    SELECT p_size AS run_no, p_partkey % 18 + 1 AS range_no, p_retailprice AS value FROM part)) GROUP BY plot""")
def paired_keys(spark, sf_dir):
    sheet = views.table(spark, sf_dir, "part").select(
        (c("p_partkey") % 18 + 1).alias("rangeNo"), c("p_size").alias("runNo"), c("p_retailprice").alias("value"), c("p_partkey").alias("row_no"))
    keyed = keys.key_sheet(sheet, "rangeNo", row_column="runNo")
    return keyed.frame.groupBy("plot").agg(F.count(F.lit(1)).alias("rows"), rounded(F.avg("value")).alias("mean_value"))


@query("j03_duplicate_keys", views.with_views("SELECT plot, count(*) AS rows FROM sheet GROUP BY plot HAVING count(*) > 1", "v_reference", ctes=SHEET_CTE))
def duplicate_keys(spark, sf_dir):
    return _sheet(spark, sf_dir).duplicate_keys


@query("j05_match_report", views.with_views("""
SELECT (SELECT count(*) FROM sheet) AS sheet_rows, 3 AS sheet_columns, (SELECT count(*) FROM (SELECT plot FROM sheet GROUP BY plot HAVING count(*) > 1)) AS duplicate_keys,
       count(*) AS plots, count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE NOT m) AS unmatched
FROM (SELECT DISTINCT plot, plot IN (SELECT plot FROM sheet) AS m FROM v_points)""", "v_points", "v_reference", ctes=SHEET_CTE))
def match_report(spark, sf_dir):
    return encode.match_report(views.points(spark, sf_dir), _sheet(spark, sf_dir))


@query("p15_one_hot", views.with_views("""
SELECT filename, """ + ", ".join(f"""CASE WHEN block IS NOT NULL THEN CASE WHEN block % 5 = {v} THEN 1e0 ELSE 0e0 END END AS "zone={v}\"""" for v in range(5)) + """,
       CASE WHEN stage IS NOT NULL THEN CASE WHEN stage = 'Z31' THEN 1e0 ELSE 0e0 END END AS "stage=Z31",
       CASE WHEN stage IS NOT NULL THEN CASE WHEN stage = 'Z65' THEN 1e0 ELSE 0e0 END END AS "stage=Z65"
FROM (SELECT DISTINCT filename, plot FROM v_points) v LEFT JOIN firsts f ON f.plot = v.plot""", "v_points", "v_reference", ctes=SHEET_CTE))
def one_hot(spark, sf_dir):
    sheet = keys.key_sheet(views.reference(spark, sf_dir).withColumn("zone", c("block") % 5), "label", SUPPLIER)
    files = views.points(spark, sf_dir).select("filename", "plot").distinct()
    return encode.one_hot(encode.lookup(files, sheet, ["zone", "stage"]).drop("plot"), sheet, ["zone", "stage"])


@query("j04_features_with_target", views.with_views("""
SELECT d.filename, round(f0, 6) AS f0, round(t.target, 6) AS target FROM v_dataset d
LEFT JOIN (SELECT filename, target FROM v_dataset WHERE plot % 4 <> 1) t ON t.filename = d.filename""", "v_dataset"))
def features_with_target(spark, sf_dir):
    data = views.dataset(spark, sf_dir)
    joined = encode.join_target(data.select("filename", "f0"), data.where(c("plot") % 4 != 1).select("filename", "target", "f1"))
    return joined.select("filename", rounded("f0").alias("f0"), rounded("target").alias("target"))


@query("f05_labelled_rows", views.with_views("SELECT filename, concat('plot:', CAST(plot AS VARCHAR)) AS grp, aug > 0 AS is_aug, round(target, 6) AS y FROM v_dataset WHERE plot % 4 <> 1 AND plot % 4 <> 2", "v_dataset"))
def labelled_rows(spark, sf_dir):
    from plotspark.models.design import labelled_rows as rows

    data = views.dataset(spark, sf_dir)
    text = F.when(c("plot") % 4 == 1, F.lit("missing")).when(c("plot") % 4 == 2, F.lit("NaN")).otherwise(c("target").cast("string"))
    return rows(data.withColumn("target", text), ["f0"], "target").select("filename", "grp", "is_aug", rounded("y").alias("y"))


@query("k05_auto_grid", views.with_views("""
SELECT n, rows, CAST(greatest(1, ceil(n / CAST(rows AS DOUBLE))) AS BIGINT) AS cols, base FROM (
  SELECT count(*) AS n, CAST(greatest(1, ceil(sqrt(count(*)))) AS BIGINT) AS rows, min(plot) AS base FROM (SELECT DISTINCT plot FROM v_points))""", "v_points"))
def auto_grid(spark, sf_dir):
    return spatial.auto_grid(views.points(spark, sf_dir))


@query("k06_column_order", """
SELECT "column", cls, type, row_number() OVER (ORDER BY ord IS NULL, ord, position) AS place FROM (
  SELECT "column", min(p_partkey) AS position FROM (
    SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'B_mean' WHEN 1 THEN 'h_std' WHEN 2 THEN 'h_mean' WHEN 3 THEN 'asym_minor' WHEN 4 THEN 'entropy' WHEN 5 THEN 'ppr' ELSE p_type END AS "column" FROM part)
  GROUP BY "column") JOIN (SELECT * FROM (VALUES ('h_mean', 'Height', 'Central tendency', 0), ('h_std', 'Height', 'Spread', 7), ('entropy', 'Height', 'Structure', 11), ('ppr', 'Height', 'Density', 14),
  ('B_mean', 'Color', 'Colour', 17), ('asym_minor', '2D', 'Horizontal (hand-crafted)', 22)) AS r("column", cls, type, ord)
  UNION ALL SELECT DISTINCT p_type, 'Imported / other', '', CAST(NULL AS INT) FROM part) USING ("column")""")
def column_order(spark, sf_dir):
    from plotspark.operators.results import grouped_columns

    names = ("B_mean", "h_std", "h_mean", "asym_minor", "entropy", "ppr")
    column = c("p_type")
    for i, name in enumerate(names):
        column = F.when(c("p_partkey") % 7 == i, F.lit(name)).otherwise(column)
    columns = views.table(spark, sf_dir, "part").groupBy(column.alias("column")).agg(F.min("p_partkey").alias("position"))
    return grouped_columns(columns).withColumn("place", c("place").cast("bigint"))
