import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotspark.config import FeatureConfig
from plotspark.operators import features as ft


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def heights(cloud, values, **extra):
    return cloud([{"height": v, "x": i % 7, "y": i // 7, **extra} for i, v in enumerate(values)])


def test_percentiles_of_a_ramp(cloud):
    got = one(ft.compute_features(heights(cloud, [0, 1, 2, 3, 4]), ["h_mean", "h_median", "h_max", "h_p25", "h_p75", "h_p95"]))
    assert got["h_mean"] == 2 and got["h_median"] == 2 and got["h_max"] == 4
    assert got["h_p25"] == 1 and got["h_p75"] == 3 and got["h_p95"] == pytest.approx(3.8)


def test_quantiles_match_numpy_for_any_scale(spark):
    from plotspark.operators.ranking import MAGNITUDE, METRIC, group_quantiles

    rng = np.random.default_rng(3)
    groups = {"tiny": rng.normal(0, 1e-7, 301), "huge": rng.normal(4.5e6, 0.01, 300), "ties": rng.integers(0, 3, 500).astype(float),
              "tail": np.append(rng.normal(0, 1, 99), 1e12), "single": np.array([-2.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}
    for buckets in (MAGNITUDE, METRIC):
        for row in group_quantiles(df, ["k"], "v", shares, buckets).collect():
            want = np.quantile(groups[row["k"]], list(shares.values()))
            assert np.allclose([row[n] for n in shares], want, rtol=1e-12, atol=0)


def test_constant_heights(cloud):
    got = one(ft.compute_features(heights(cloud, [5, 5, 5, 5]), ["h_var", "h_std", "h_cv", "entropy", "h_skew", "h_kurtosis"]))
    assert got["h_var"] == 0 and got["h_std"] == 0 and got["h_cv"] == 0 and got["entropy"] == pytest.approx(0, abs=1e-12)
    assert got["h_skew"] is None and got["h_kurtosis"] is None


def test_shape_moments(cloud):
    h = np.array([0, 1, 2, 3, 10.0])
    got = one(ft.compute_features(heights(cloud, h), ["h_skew", "h_kurtosis", "h_cv"]))
    d = h - h.mean()
    assert got["h_skew"] == pytest.approx((d ** 3).mean() / (d ** 2).mean() ** 1.5)
    assert got["h_kurtosis"] == pytest.approx((d ** 4).mean() / (d ** 2).mean() ** 2 - 3)
    assert got["h_cv"] == pytest.approx(h.std(ddof=1) / h.mean())


@pytest.mark.parametrize("values, width, bits", [((0.1, 0.2, 5.1, 5.2), 0.5, 1.0), ((0.05, 0.15, 0.25, 0.35), 0.1, 2.0)])
def test_entropy_in_bits(cloud, values, width, bits):
    assert one(ft.compute_features(heights(cloud, values), ["entropy"], FeatureConfig(entropy_bin=width)))["entropy"] == pytest.approx(bits)


def test_entropy_equals_histogram_rule(cloud):
    rng = np.random.default_rng(7)
    for width, values in ((0.1, np.round(rng.uniform(-1, 2, 300), 1)), (0.3, np.round(rng.normal(0, 1, 300), 2)), (0.1, np.zeros(5))):
        lo = math.floor(min(0.0, values.min()))
        hist, _ = np.histogram(values, bins=np.arange(lo, values.max() + width, width)) if values.max() > 0 else (np.zeros(1), None)
        share = hist[hist > 0] / max(hist.sum(), 1)
        want = None if hist.sum() == 0 else float(-(share * np.log2(share)).sum())
        got = one(ft.compute_features(heights(cloud, values), ["entropy"], FeatureConfig(entropy_bin=width)))["entropy"]
        assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


def test_tilted_plane_has_no_roughness(cloud):
    rng = np.random.default_rng(1)
    rows = [{"x": x, "y": y, "height": 2 * x + 3 * y + 1} for x, y in rng.uniform(0, 4, (60, 2))]
    got = one(ft.compute_features(cloud(rows), ["sigma_z"]))
    assert got["sigma_z"] == pytest.approx(0, abs=1e-6)
    line = [{"x": t, "y": 2 * t, "height": 5 * t + 1} for t in range(9)]  # all points on one line
    assert one(ft.compute_features(cloud(line), ["sigma_z"]))["sigma_z"] == pytest.approx(0, abs=1e-6)
    spot = [{"x": 1, "y": 1, "height": h} for h in (0, 1, 5)]
    assert one(ft.compute_features(cloud(spot), ["sigma_z"]))["sigma_z"] == pytest.approx(np.std([0, 1, 5]))


def test_shares(cloud):
    assert one(ft.compute_features(heights(cloud, [0, 0, 0, 10]), ["frac_above_mean"]))["frac_above_mean"] == 0.25
    rows = [{"classification": 2}] * 3 + [{"classification": 1}] * 7
    assert one(ft.compute_features(cloud(rows), ["ppr"]))["ppr"] == pytest.approx(0.3)


def test_colours_use_vegetation_only(cloud):
    rows = [{"red": 10, "green": 20, "blue": 30}] * 4 + [{"classification": 2, "red": 99, "green": 99, "blue": 99}] * 2
    got = one(ft.compute_features(cloud(rows), ["R_mean", "G_mean", "B_mean"]))
    assert (got["R_mean"], got["G_mean"], got["B_mean"]) == (10, 20, 30)
    bare = one(ft.compute_features(cloud(rows).drop("red", "green", "blue"), ["R_mean", "G_mean", "B_mean"]))
    assert set(bare.values()) == {None, "plot(1).laz"}
    unset = one(ft.compute_features(cloud(rows), ["R_mean"], FeatureConfig(red=None)))
    assert unset["R_mean"] is None


def strip(seed=0, angle=0.0, shift=(0.0, 0.0)):
    rng = np.random.default_rng(seed)
    sx, sy = rng.uniform(0, 4, 600) ** 1.1, rng.uniform(0, 1, 600)
    h = 0.5 + 0.05 * sx + rng.normal(0, 0.05, 600)
    a = math.radians(angle)
    x, y = sx * math.cos(a) - sy * math.sin(a) + shift[0], sx * math.sin(a) + sy * math.cos(a) + shift[1]
    return [{"x": float(i), "y": float(j), "height": float(k)} for i, j, k in zip(x, y, h)]


HORIZONTAL = [k for k, f in ft.FEATURES.items() if f.cls == "2D"]


def test_horizontal_features_ignore_rotation_and_shift(cloud):
    assert len(HORIZONTAL) == 9
    here = one(ft.compute_features(cloud(strip()), HORIZONTAL))
    there = one(ft.compute_features(cloud(strip(angle=53, shift=(1000, -200))), HORIZONTAL))
    for key in HORIZONTAL:
        assert here[key] == pytest.approx(there[key], abs=1e-6), key
    assert here["pca_spread_major"] > here["pca_spread_minor"] and 0 <= here["asym_major"] <= 1


def test_horizontal_features_against_numpy(cloud):
    rows = strip(5, 20)
    x, y, h = (np.array([r[k] for r in rows]) for k in ("x", "y", "height"))
    got = one(ft.compute_features(cloud(rows), HORIZONTAL))
    values, vectors = np.linalg.eigh(np.cov(x, y))
    major, minor = vectors[:, 1], vectors[:, 0]
    assert got["pca_spread_major"] == pytest.approx(math.sqrt(values[1])) and got["pca_spread_minor"] == pytest.approx(math.sqrt(values[0]))
    for axis, name in ((major, "major"), (minor, "minor")):
        s = np.column_stack([x - x.mean(), y - y.mean()]) @ axis
        assert got[f"asym_{name}"] == pytest.approx(abs((s > 0).sum() - (s < 0).sum()) / ((s > 0).sum() + (s < 0).sum()))
        assert got[f"rough_{name}"] == pytest.approx(np.std(h - np.polyval(np.polyfit(s, h, 1), s)))
        top, low = h >= np.percentile(h, 95), h <= np.percentile(h, 5)
        turn = np.arctan(np.polyfit(s[top], h[top], 1)[0]) - np.arctan(np.polyfit(s[low], h[low], 1)[0])
        assert got[f"slope_angle_{name}"] == pytest.approx(abs(np.degrees(turn)))


def test_guards_for_few_points(cloud):
    points = []
    for n in (0, 1, 2, 3):
        some = [{"x": i, "y": i * i, "height": i + 1.0} for i in range(n)] + [{"classification": 2}]
        points += [{**p, "filename": f"plot({n}).laz"} for p in some]
    rows = {int(r["filename"][5]): r for r in ft.compute_features(cloud(points)).collect()}
    assert len(rows) == 4
    for n, got in rows.items():
        assert got["ppr"] == pytest.approx(1 / (n + 1))
        assert (got["h_mean"] is None) == (n < 1) and (got["h_median"] is None) == (n < 1)
        assert (got["h_std"] is None) == (n < 2) and (got["h_cv"] is None) == (n < 2)
        assert (got["pca_spread_major"] is None) == (n < 2) and (got["rough_major"] is None) == (n < 2)
        assert (got["h_skew"] is None) == (n < 3) and (got["sigma_z"] is None) == (n < 3)
        assert got["h_kurtosis"] is None


def test_registry_order_and_selection(cloud):
    df = ft.compute_features(cloud([{"height": 1}]), ["ppr", "h_mean"])
    assert df.columns == ["filename", "h_mean", "ppr"]
    assert len(ft.FEATURES) == 27
    with pytest.raises(KeyError):
        ft.compute_features(cloud([{}]), ["nope"])
    with pytest.raises(ValueError):
        ft.compute_features(cloud([{}]), ["slope_angle_major"], FeatureConfig(strata_pct=50.0))


def test_registered_feature_with_its_own_aggregate(cloud):
    ft.register_feature(ft.FeatureDef("z_top", "Height", "Spread", "largest x of tall points", ("n", "x_top"), lambda: F.col("x_top"),
                                      {"x_top": lambda cfg: F.max(F.when(F.col("veg") & (F.col("h") > 1), F.col("x")))}))
    try:
        got = one(ft.compute_features(cloud([{"x": 3, "height": 2}, {"x": 9, "height": 0.5}]), ["z_top", "h_max"]))
        assert got["z_top"] == 3 and got["h_max"] == 2
        with pytest.raises(ValueError):
            ft.register_feature(ft.FEATURES["h_mean"])
    finally:
        ft.FEATURES.pop("z_top")


def test_python_feature_is_merged_over_chunks(cloud):
    rows = [{"x": i, "height": i / 10} for i in range(100)]
    df = ft.grouped_feature(cloud(rows), "h_sum", lambda p: [p["h"].sum()], lambda parts: [sum(p[0] for p in parts)], lambda t: t[0], chunk_points=7, fan_in=3)
    assert one(df)["h_sum"] == pytest.approx(sum(i / 10 for i in range(100)))


def test_channels(spark, cloud):
    from plotspark.sources.channels import channel_listing, channel_value, missing_channel

    pts = cloud([{"z": 3}], "a.laz").unionByName(cloud([{"z": 4}], "b.laz")).drop("height")
    pts = pts.withColumn("extra", F.when(F.col("filename") == "a.laz", F.create_map(F.lit("RelativeHeight"), F.lit(0.7))))
    assert one(ft.compute_features(pts.where("filename = 'a.laz'"), ["h_max"], FeatureConfig(height="RelativeHeight")))["h_max"] == 0.7
    assert one(ft.compute_features(pts.where("filename = 'b.laz'"), ["h_max"], FeatureConfig(height="Z")))["h_max"] == 4
    failed = missing_channel(pts, "RelativeHeight").collect()
    assert [r["filename"] for r in failed] == ["b.laz"] and "available: x, y, z" in failed[0]["reason"]
    assert {r["dimension"]: r["clouds"] for r in channel_listing(pts).collect()}["RelativeHeight"] == 1
    with pytest.raises(KeyError):
        channel_value(pts.drop("extra"), "nope")
