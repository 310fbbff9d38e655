import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotspark.operators import augment as ag
from plotspark.operators import spatial as sp
from plotspark.operators.groups import together, whole_groups
from plotspark.sources.masks import features_from_geojson, list_mask_fields, load_masks, masks_from_vertices, read_geojson

c = F.col


def polygon(spark, shapes):
    rows = [(label, ring, i, float(x), float(y)) for label, rings in shapes.items() for ring, pts in enumerate(rings) for i, (x, y) in enumerate(pts)]
    return masks_from_vertices(spark.createDataFrame(rows, "label int, ring int, seq int, x double, y double"))


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_clip_is_strict_and_may_match_twice(spark, cloud, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    pts = cloud([{"x": 1, "y": 1}, {"x": 9, "y": 9}, {"x": 20, "y": 20}, {"x": 0, "y": 5}, {"x": 10, "y": 10}, {"x": 5, "y": 0}])
    masks = polygon(spark, {1: [SQUARE], 2: [[(0.5, 0.5), (2, 0.5), (2, 2), (0.5, 2)]], 3: [[(50, 50), (60, 50), (60, 60)]]})
    got = sp.points_in_masks(pts, masks)
    try:
        assert sorted((r["label"], r["point_id"]) for r in got.collect()) == [(1, 0), (1, 1), (2, 0)]
        assert [r["label"] for r in sp.empty_masks(masks, got).collect()] == [3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clip_with_masks_of_very_different_size(spark, cloud):
    field = [(-5000, -5000), (5000, -5000), (5000, 5000), (-5000, 5000)]
    shapes = {100: [field]} | {k: [[(k, 0), (k + 1, 0), (k + 1, 1), (k, 1)]] for k in range(40)}
    pts = cloud([{"x": k + 0.5, "y": 0.5} for k in range(40)] + [{"x": 0.5, "y": 0.25}] * 500 + [{"x": 6000, "y": 0}])
    got = sp.points_in_masks(pts, polygon(spark, shapes)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {100: 540, 0: 501, **{k: 1 for k in range(1, 40)}}
    assert sp.points_in_masks(pts, polygon(spark, shapes).limit(0)).count() == 0


def test_points_stay_where_they_are_for_few_masks(spark, cloud, monkeypatch):
    points = cloud([{"x": x / 10, "y": 0.5} for x in range(-5, 30)])
    masks = polygon(spark, {1: [[(0, 0), (1, 0), (1, 1), (0, 1)]], 2: [[(-100, -100), (100, -100), (100, 100), (-100, 100)]]})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sp.points_in_masks(points, masks)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(sp, "BROADCAST_BYTES", 0)
        cut = sp.points_in_masks(points, masks)
        rows = lambda df: sorted((r.label, r.point_id) for r in df.collect())
        assert rows(found) == rows(cut) and len(rows(cut)) == 9 + 35
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_groups_over_batches_are_whole():
    rows = pd.DataFrame({"a": ["x", "x", None, None, "y", "y", "y", "z"], "b": [1, 1, 1, 1, 1, 2, 2, 2], "v": range(8)})
    for cut in range(1, 9):
        batches = [rows.iloc[i : i + cut] for i in range(0, 8, cut)]
        assert [p["v"].tolist() for p in whole_groups(iter(batches), ["a", "b"])] == [[0, 1], [2, 3], [4], [5, 6], [7]]


def test_small_frames_travel_together():
    got = list(together(pd.DataFrame({"v": range(i, i + 30)}) for i in range(0, 24_000, 30)))
    assert len(got) == 3 and pd.concat(got)["v"].tolist() == list(range(24_000))


def test_small_groups_keep_their_points():
    rows = pd.DataFrame({"plot": ["a", "b", "a", None, "a", "a", "a"], "x": [0.0, 5.0, 2.0, 7.0, 2.0, 0.0, 1.0], "y": [0.0, 5.0, 0.0, 7.0, 2.0, 2.0, 1.0]})
    got = sp._group_hulls(rows, ["plot"])
    assert sorted(zip(got["plot"].fillna("?"), got["x"], got["y"])) == [("?", 7, 7), ("a", 0, 0), ("a", 0, 2), ("a", 2, 0), ("a", 2, 2), ("b", 5, 5)]


def test_holes_and_concave_shapes(spark, cloud):
    hole = [(4, 4), (6, 4), (6, 6), (4, 6)]
    masks = polygon(spark, {1: [SQUARE, hole], 2: [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]]})
    pts = cloud([{"x": 5, "y": 5}, {"x": 3, "y": 5}, {"x": 4, "y": 5}, {"x": 2, "y": 2}, {"x": 0.5, "y": 2}])
    got = {(r["label"], r["point_id"]) for r in sp.points_in_masks(pts, masks).collect()}
    assert got == {(1, 1), (1, 3), (1, 4), (2, 4)}


def test_masks_from_geojson(spark, tmp_path):
    ring = "[[0,0],[1,0],[1,1],[0,1],[0,0]]"
    lines = [
        '{"type":"Feature","properties":{"tag":"P_429_a"},"geometry":{"type":"Polygon","coordinates":[%s]}}' % ring,
        '{"type":"Feature","properties":{"tag":"430"},"geometry":{"type":"MultiPolygon","coordinates":[[%s],[%s]]}}' % (ring, ring),
        '{"type":"Feature","properties":{"tag":"none"},"geometry":{"type":"Polygon","coordinates":[%s]}}' % ring,
        '{"type":"Feature","properties":{"tag":"431"},"geometry":null}']
    from plotspark.functions.naming import LabelFormat

    features = features_from_geojson(spark.createDataFrame([(x,) for x in lines], "value string"))
    masks, unreadable = load_masks(features, "tag", LabelFormat("P_", "_a"))
    assert {r["label"]: len(r["rings"]) for r in masks.collect()} == {429: 1, 430: 2}
    assert [r["label_text"] for r in unreadable.collect()] == ["none"] and [r["field"] for r in list_mask_fields(features).collect()] == ["tag"]
    path = tmp_path / "masks.geojsonl"
    path.write_text("\n".join(lines))
    assert read_geojson(spark, str(path), "tag")[0].count() == 1  # default format: only the bare number reads
    with pytest.raises(KeyError, match="tag"):
        read_geojson(spark, str(path), "plot_id")


def test_hull_and_rectangle(cloud, spark):
    rng = np.random.default_rng(0)
    a = math.radians(25)
    xy = rng.uniform(0, 1, (2000, 2)) * [20, 6]
    xy = xy @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + [1000, 500]
    pts = cloud([{"x": x, "y": y} for x, y in xy]).withColumn("plot", F.lit(1)).repartition(6)
    line = cloud([{"x": i, "y": 2 * i} for i in range(9)]).withColumn("plot", F.lit(2))
    hulls = {r["plot"]: r["hull"] for r in sp.convex_hulls(pts.unionByName(line), partitions_per_part=2).collect()}
    assert hulls[2] is None
    hull = np.array([[p["x"], p["y"]] for p in hulls[1]])
    edges = np.roll(hull, -1, axis=0) - hull
    cross = edges[:, None, 0] * (xy[None, :, 1] - hull[:, None, 1]) - edges[:, None, 1] * (xy[None, :, 0] - hull[:, None, 0])
    assert (cross >= -1e-6).all() and {tuple(p) for p in hull} <= {tuple(p) for p in xy}
    from plotspark.functions.scalars import box_angle, box_sides

    boxes = sp.min_area_rectangles(sp.convex_hulls(pts))
    short, long = box_sides(c("corners"))
    row = boxes.select(short.alias("s"), long.alias("l"), box_angle(c("corners")).alias("a")).first()
    assert row["s"] == pytest.approx(6, abs=0.5) and row["l"] == pytest.approx(20, abs=0.5) and row["a"] == pytest.approx(25, abs=1)


def test_hull_pruning_keeps_every_vertex():
    rng = np.random.default_rng(5)
    for n in (70, 400, 3000):
        circle = rng.uniform(0, 2 * np.pi, n)
        xy = np.column_stack([np.cos(circle), np.sin(circle)]) * rng.choice([1.0, 0.3], n)[:, None]
        full = {tuple(p) for p in sp.hull_of(xy[:64])}
        assert full and {tuple(p) for p in sp.hull_of(xy)} == {tuple(p) for p in sp.hull_of(sp._outer_points(xy))}


def test_border_filter_keeps_hulls(spark):
    rng = np.random.default_rng(8)
    shapes = {1: rng.normal(0, 1, (500, 2)), 2: rng.integers(0, 6, (400, 2)).astype(float), 3: np.column_stack([np.arange(100.0), np.arange(100.0)]), 4: np.zeros((90, 2)), 5: rng.random((40, 2))}
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, xy in shapes.items() for x, y in xy], "plot int, x double, y double").repartition(5)
    left = sp.border_points(pts, ["plot"]).groupBy("plot").count().collect()
    sizes = {r["plot"]: r["count"] for r in left}
    assert sizes[1] < 200 and sizes[4] == 90 and sizes[3] == 100 and sizes[5] == 40
    hulls = {r["plot"]: r["hull"] for r in sp.convex_hulls(pts).collect()}
    for k in (1, 2, 5):
        assert {(p["x"], p["y"]) for p in hulls[k]} == {tuple(p) for p in sp.hull_of(shapes[k])}
    assert hulls.get(3) is None and hulls.get(4) is None


def test_trim_with_a_narrow_band(spark):
    rng = np.random.default_rng(9)
    xy = rng.normal(0, 1, (60, 2))
    pts = spark.createDataFrame([(1, float(x), float(y)) for x, y in xy] + [(2, float(i % 5), float(i // 5)) for i in range(19)], "plot int, x double, y double")
    lo, hi = np.quantile(xy, 0.3, axis=0), np.quantile(xy, 0.7, axis=0)
    kept = sp.trim_outliers(pts, lo=0.3, hi=0.7).groupBy("plot").count().collect()
    want = int(((xy >= lo) & (xy <= hi)).all(axis=1).sum())
    assert {r["plot"]: r["count"] for r in kept} == {1: want if want >= 3 else 60, 2: 19}


def test_trim(cloud):
    rng = np.random.default_rng(0)
    rows = [{"x": x, "y": y} for x, y in rng.uniform(0, 10, (400, 2))] + [{"x": 500, "y": 5}]
    pts = cloud(rows).withColumn("plot", F.lit(1)).unionByName(cloud([{"x": i} for i in range(5)]).withColumn("plot", F.lit(2)))
    kept = sp.trim_outliers(pts)
    assert kept.where("plot = 2").count() == 5
    assert kept.where("plot = 1").agg(F.max("x")).first()[0] < 11 and kept.where("plot = 1").count() > 380


def test_grid_placement(spark, cloud):
    clouds = None
    for i, (x, y) in enumerate([(0, 0), (100, 7), (-40, 3)]):
        part = cloud([{"x": x, "y": y, "z": 5}, {"x": x + 2, "y": y + 2, "z": 6}], f"plot({i + 1}).laz")
        clouds = part if clouds is None else clouds.unionByName(part)
    entries = spark.createDataFrame([(f"plot({i}).laz", i, i, None) for i in (1, 2, 3)], "filename string, number int, col int, row int")
    cells = sp.grid_cells(entries, 2)
    moved = sp.place_on_grid(clouds, cells.select("filename", "cell_col", "cell_row"), sp.grid_pitch(sp.largest_spans(clouds), 0.10))
    centers = {r["filename"]: (r["cx"], r["cy"]) for r in sp.bounds(moved, ["filename"]).collect()}
    assert centers["plot(1).laz"] == pytest.approx((0, 0)) and centers["plot(2).laz"] == pytest.approx((2.2, 0)) and centers["plot(3).laz"] == pytest.approx((0, -2.2))


def layout(spark, **kw):
    return {r["plot"]: (r["row"], r["col"]) for r in sp.field_layout(spark, 8, 10, 429, **kw).collect()}


def test_layouts(spark):
    plain = layout(spark)
    assert (plain[429], plain[438], plain[439], plain[508]) == ((0, 0), (0, 9), (1, 0), (7, 9))
    snake = layout(spark, start="top-right", snake=True)
    assert [snake[p] for p in (438, 429, 439, 448, 499, 508)] == [(0, 0), (0, 9), (1, 0), (1, 9), (7, 0), (7, 9)]
    columns = layout(spark, start="bottom-left", major="column")
    assert columns[429] == (7, 0) and columns[436] == (0, 0) and columns[437] == (7, 1)
    assert sp.field_layout(spark, 0, 5, 1).count() == 0


def test_label_remap(spark):
    masks = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "label int, name string, geometry int")
    remap = spark.createDataFrame([(1, 2), (2, 1), (3, 9)], "label int, partner int")
    got = {r["geometry"]: (r["label"], r["name"], r["orig_label"], r["moved"]) for r in sp.remap_labels(masks, remap, ["name"]).collect()}
    assert got == {10: (2, "b", 1, True), 20: (1, "a", 2, True), 30: (3, "c", 3, False)}


# --------------------------------------------------------------------------------- augmentation
def field(cloud, n=100):
    rng = np.random.default_rng(8)
    return cloud([{"x": x, "y": y, "z": z, "height": z, "classification": 1 + i % 2} for i, (x, y, z) in enumerate(rng.uniform(0, 10, (n, 3)))], "field_plot(429).laz")


def run(points, method, value, **kw):
    cfg = ag.AugmentConfig([method], 1, 1, copies=1, ranges={method: (value, value)}, **kw)
    return ag.augment(points, cfg)


def frame(df):
    return df.orderBy("point_id").toPandas()


def test_rotation_keeps_distances(cloud):
    pts = field(cloud)
    before, after = frame(pts), frame(run(pts, "rotation_z", 90.0))
    assert np.allclose(after["x"], before["x"].mean() - (before["y"] - before["y"].mean()))
    assert np.allclose(after["y"], before["y"].mean() + (before["x"] - before["x"].mean())) and (after["z"] == before["z"]).all()


def test_flip_mirrors_one_axis(cloud):
    pts = field(cloud)
    before, after = frame(pts), frame(run(pts, "flip_h", 0.0))
    x_flipped = np.allclose(after["x"], 2 * before["x"].mean() - before["x"]) and np.allclose(after["y"], before["y"])
    y_flipped = np.allclose(after["y"], 2 * before["y"].mean() - before["y"]) and np.allclose(after["x"], before["x"])
    assert x_flipped != y_flipped


def test_jitter(cloud):
    pts = field(cloud, 2000)
    before = frame(pts)
    flat = frame(run(pts, "jitter_xy", 0.5))
    dx, dy = flat["x"] - before["x"], flat["y"] - before["y"]
    assert dx.std() == pytest.approx(0.5, rel=0.1) and dy.std() == pytest.approx(0.5, rel=0.1) and abs(np.corrcoef(dx, dy)[0, 1]) < 0.08
    up = frame(run(pts, "jitter_z", 0.5))
    assert np.allclose(up["z"] - before["z"], up["height"] - before["height"]) and (up["z"] - before["z"]).std() == pytest.approx(0.5, rel=0.1)
    raw = frame(run(pts, "jitter_z", 0.5, height="z"))
    assert np.allclose(raw["z"], up["z"]) and (raw["height"] == before["height"]).all()


def test_sampling_sizes(cloud):
    pts = field(cloud)
    kept = run(pts, "dropout", 0.3)
    assert kept.count() == 70 == kept.select("point_id").distinct().count()
    drawn = run(pts, "bootstrap", 1.25)
    assert drawn.count() == 125 > drawn.select("point_id").distinct().count()
    assert run(pts, "dropout", 1.0).count() == 1


def test_dropout_ranks_small_clouds_in_one_move(cloud, monkeypatch):
    pts = field(cloud, 400).unionByName(field(cloud, 30).withColumn("filename", F.lit("plot(2).laz")))
    plan = run(pts, "dropout", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" in plan and "_p_dropout#" in plan
    assert not [line for line in plan.splitlines() if "Filter" in line and "isnull(_p_dropout" in line]  # no pass for copies that cannot be
    found = []
    for whole in (1_000, 100, 1):  # all small, one of each, all large
        monkeypatch.setattr(ag, "WHOLE_ROWS", whole)
        found.append(sorted((r["filename"], r["point_id"]) for r in run(pts, "dropout", 0.3).collect()))
    assert len(found[0]) == 280 + 21 and found[0] == found[1] == found[2]


def test_draws_of_a_bootstrap_are_not_broadcast(cloud):
    plan = run(field(cloud), "bootstrap", 1.0)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_no#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_runs_do_not_depend_on_partitioning(cloud):
    cfg = ag.AugmentConfig(list(ag.AUGMENTATIONS), 1, 4, copies=3, seed=2, ranges={"bootstrap": (0.5, 0.9)})
    columns = ["copy", "point_id", "x", "y", "z", "height"]
    one = ag.augment(field(cloud).coalesce(1), cfg).select(columns).collect()
    many = ag.augment(field(cloud).repartition(7), cfg).select(columns).collect()
    key = lambda r: tuple(round(v, 9) for v in r)
    assert sorted(map(key, one)) == sorted(map(key, many))
    assert {r["copy"] for r in one} == {1, 2, 3}


def test_plan_bounds_and_manifest(spark):
    files = spark.createDataFrame([(f"plot({i}).laz",) for i in range(60)], "filename string")
    cfg = ag.AugmentConfig(["dropout", "rotation_z", "flip_h"], 2, 9, copies=2)
    assert cfg.bounds() == (2, 3)
    plan = ag.draw_plan(files, cfg)
    rows = ag.plan_rows(plan).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["filename"], r["copy"]), []).append(r["method"])
    assert {len(v) for v in sizes.values()} == {2, 3} and len(sizes) == 120
    order = list(ag.AUGMENTATIONS)
    assert all(v == sorted(v, key=order.index) for v in sizes.values())
    assert all(0 <= r["value"] <= 0.3 for r in rows if r["method"] == "dropout")
    table = ag.manifest(files, plan, cfg)
    assert table.count() == 180 and table.where("aug_id = 0 and n_methods = 0").count() == 60
    sample = table.where("rotation_z <> ''").first()
    assert sample["rotation_z"].startswith("angle_deg=") and sample["output_file"].endswith(f"_aug({sample['aug_id']}).laz")
    assert ag.plan_rows(ag.draw_plan(files, ag.AugmentConfig([]))).count() == 0
    assert "seed = 0" in ag.provenance(cfg) and "range:dropout.fraction = 0.0 .. 0.3" in ag.provenance(cfg)


def test_registered_augmentation(cloud):
    lift = ag.Augmentation("lift", "by_m", 1.0, 1.0, lambda p, v, h, s: p.withColumn("z", F.when(v.isNotNull(), c("z") + v).otherwise(c("z"))))
    ag.register_augmentation(lift)
    try:
        assert list(ag.AUGMENTATIONS)[-2:] == ["dropout", "bootstrap"]
        pts = field(cloud)
        assert np.allclose(frame(run(pts, "lift", 1.0))["z"], frame(pts)["z"] + 1)
        with pytest.raises(ValueError):
            ag.register_augmentation(lift)
    finally:
        ag.AUGMENTATIONS.pop("lift")


def test_originals_join_their_copies(cloud):
    pts = field(cloud)
    both = ag.with_originals(pts, run(pts, "dropout", 0.5))
    assert {r["copy"]: r["count"] for r in both.groupBy("copy").count().collect()} == {0: 100, 1: 50}
    assert both.where("copy = 0").first()["output_file"] == "field_plot(429).laz"
