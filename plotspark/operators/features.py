"""The 27 per-cloud features as declarative aggregates.

A feature names the intermediate values it is computed from; every intermediate belongs to one pass over the points:

* ``base``    one aggregation: counts, moments, covariances, channel means (all single-pass, centred by Spark);
* ``levels``  exact height percentiles (two-level histogram, see ranking.py);
* ``frame``   a second aggregation relative to the cloud's own centroid, plane and principal axes;
* ``layers``  counts per height layer.

Only the passes that the chosen features need are planned, and only over the columns they need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.config import FeatureConfig
from plotspark.functions.aggregates import slope
from plotspark.functions.scalars import balance_index
from plotspark.operators.groups import map_groups
from plotspark.operators.ranking import METRIC, group_quantiles, salted_join

c = F.col


@dataclass(frozen=True)
class FeatureDef:
    """One feature: its labels, the intermediates it reads and its value as a Column of them.

    ``aggregates`` adds extra aggregates over all points of a cloud (``veg`` flags vegetation) to the base pass, which
    is how a user-defined feature brings its own.
    """

    key: str
    cls: str
    group: str
    doc: str
    uses: tuple[str, ...]
    value: Callable[[], Column]
    aggregates: dict[str, Callable[[FeatureConfig], Column]] = field(default_factory=dict)


# --------------------------------------------------------------------- intermediates per pass
def _veg(column: str) -> Column:
    return F.when(c("veg"), c(column))


BASE: dict[str, Callable[[FeatureConfig], Column]] = {
    "n_all": lambda cfg: F.count(F.lit(1)),
    "n_ground": lambda cfg: F.count_if(c("classification") == cfg.ground_code),
    "n": lambda cfg: F.count(_veg("h")),
    "h_avg": lambda cfg: F.avg(_veg("h")),
    "h_lo": lambda cfg: F.min(_veg("h")),
    "h_hi": lambda cfg: F.max(_veg("h")),
    "h_vs": lambda cfg: F.var_samp(_veg("h")),
    "h_g1": lambda cfg: F.skewness(_veg("h")),
    "h_g2": lambda cfg: F.kurtosis(_veg("h")),
    "x_avg": lambda cfg: F.avg(_veg("x")),
    "y_avg": lambda cfg: F.avg(_veg("y")),
    "x_vs": lambda cfg: F.var_samp(_veg("x")),
    "y_vs": lambda cfg: F.var_samp(_veg("y")),
    "xy_cs": lambda cfg: F.covar_samp(_veg("x"), _veg("y")),
    "xh_cs": lambda cfg: F.covar_samp(_veg("x"), _veg("h")),
    "yh_cs": lambda cfg: F.covar_samp(_veg("y"), _veg("h")),
    "red_avg": lambda cfg: F.avg(_veg(cfg.red)) if cfg.red else F.max(F.lit(None).cast("double")),
    "green_avg": lambda cfg: F.avg(_veg(cfg.green)) if cfg.green else F.max(F.lit(None).cast("double")),
    "blue_avg": lambda cfg: F.avg(_veg(cfg.blue)) if cfg.blue else F.max(F.lit(None).cast("double")),
}

LEVELS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
AXES = ("n", "x_avg", "y_avg", "x_vs", "y_vs", "xy_cs")
PLANE = (*AXES, "h_avg", "xh_cs", "yh_cs")


Frame = tuple[tuple[str, ...], Callable[[], Column]]


def _residual(fitted: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.avg(F.pow(c("h") - c("h_avg") - fitted(), 2))


def _extent(value: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.max(value()) - F.min(value())


def _frame() -> dict[str, Frame]:
    """name -> (base intermediates it is relative to, aggregate over vegetation points)."""
    out: dict[str, Frame] = {
        "n_above": (("h_avg",), lambda: F.count_if(c("h") > c("h_avg"))),
        "plane_ms": (PLANE, _residual(lambda: c("plane_a") * c("dx") + c("plane_b") * c("dy"))),
        "top_n": (("cut_lo", "cut_hi"), lambda: F.count_if(c("h") >= c("cut_hi"))),
        "bottom_n": (("cut_lo", "cut_hi"), lambda: F.count_if(c("h") <= c("cut_lo"))),
    }
    inside = {"top": lambda: c("h") >= c("cut_hi"), "bottom": lambda: c("h") <= c("cut_lo")}
    for axis in ("major", "minor"):
        along = lambda axis=axis: c(f"s_{axis}")
        out[f"{axis}_pos"] = (AXES, lambda s=along: F.count_if(s() > 0))
        out[f"{axis}_neg"] = (AXES, lambda s=along: F.count_if(s() < 0))
        out[f"{axis}_range"] = (AXES, _extent(along))
        out[f"{axis}_ms"] = (PLANE, _residual(lambda s=along, axis=axis: c(f"trend_{axis}") * s()))
        for stratum, within in inside.items():
            needs = (*AXES, "cut_lo", "cut_hi")
            place = lambda s=along, w=within: F.when(w(), s())
            height = lambda w=within: F.when(w(), c("h"))
            name = f"{axis}_{stratum}"
            out[f"{name}_slope"] = (needs, lambda h=height, s=place: slope(h(), s()))
            out[f"{name}_range"] = (needs, _extent(place))
            out[f"{name}_s0"] = (needs, lambda s=place: F.avg(s()))
            out[f"{name}_h0"] = (needs, lambda h=height: F.avg(h()))
    return out


FRAME: dict[str, Frame] = _frame()


# ------------------------------------------------------------------------------ closed forms
def axis_columns(df: DataFrame) -> DataFrame:
    """Principal axes from the covariance columns: eigenvalues and unit vectors of the major and minor axis."""
    a, d, b = c("x_vs"), c("y_vs"), c("xy_cs")
    half = F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    theta = F.lit(0.5) * F.atan2(F.lit(2.0) * b, a - d)
    tie = (b == 0) & (a == d)  # equal spread both ways: the y axis counts as major
    return (
        df.withColumn("lambda_major", F.greatest((a + d) / 2 + half, F.lit(0.0)))
        .withColumn("lambda_minor", F.greatest((a + d) / 2 - half, F.lit(0.0)))
        .withColumn("major_x", F.when(tie, F.lit(0.0)).otherwise(F.cos(theta)))
        .withColumn("major_y", F.when(tie, F.lit(1.0)).otherwise(F.sin(theta)))
        .withColumn("minor_x", -c("major_y"))
        .withColumn("minor_y", c("major_x"))
    )


def plane_columns(df: DataFrame) -> DataFrame:
    """Least-squares plane h = a (x - mean) + b (y - mean) + mean and the trend along each axis, from covariances.

    A cloud on a line has no unique plane: the fit then runs along its axis, which gives the same residuals.
    """
    sxx, syy, sxy, sxh, syh = c("x_vs"), c("y_vs"), c("xy_cs"), c("xh_cs"), c("yh_cs")
    det = sxx * syy - sxy * sxy
    singular = det <= F.lit(1e-12) * sxx * syy
    for axis in ("major", "minor"):
        along = c(f"{axis}_x") * sxh + c(f"{axis}_y") * syh
        df = df.withColumn(f"trend_{axis}", F.coalesce(F.try_divide(along, F.nullif(c(f"lambda_{axis}"), F.lit(0.0))), F.lit(0.0)))
    on_line = lambda part: c("trend_major") * c(f"major_{part}")
    full_a = F.try_divide(sxh * syy - syh * sxy, det)
    full_b = F.try_divide(syh * sxx - sxh * sxy, det)
    return (
        df.withColumn("plane_a", F.when(singular, on_line("x")).otherwise(full_a))
        .withColumn("plane_b", F.when(singular, on_line("y")).otherwise(full_b))
    )


def with_projection(points: DataFrame) -> DataFrame:
    """Offsets from the centroid and coordinates along the two axes."""
    points = points.withColumn("dx", c("x") - c("x_avg")).withColumn("dy", c("y") - c("y_avg"))
    for axis in ("major", "minor"):
        points = points.withColumn(f"s_{axis}", c("dx") * c(f"{axis}_x") + c("dy") * c(f"{axis}_y"))
    return points


def layer_index(h: Column, lo: Column, hi: Column, width: float) -> Column:
    """Histogram layer of ``h`` on edges lo + i*step; null beyond the last edge or when there is no layer.

    The step is (lo + width) - lo in doubles and the index is corrected against the edges themselves, so a height that
    falls exactly on an edge lands where a half-open histogram puts it (the last layer is closed).
    """
    step = (lo + F.lit(width)) - lo
    edges = F.ceil((hi + F.lit(width) - lo) / F.lit(width))
    k = F.floor((h - lo) / step)
    k = F.when(h < lo + k * step, k - 1).when(h >= lo + (k + 1) * step, k + 1).otherwise(k)
    last = lo + (edges - 1) * step
    return F.when((edges >= 2) & (h <= last), F.least(k, edges - 2))


# -------------------------------------------------------------------------------- definitions
def _guard(minimum: int, value: Column) -> Column:
    return F.when(c("n") >= minimum, value)


def _spread(axis: str) -> Column:
    return _guard(2, F.sqrt(c(f"lambda_{axis}")))


def _slope_angle(axis: str) -> Column:
    usable = (
        (c("top_n") >= 2) & (c("bottom_n") >= 2)
        & (c(f"{axis}_top_range") > 0) & (c(f"{axis}_bottom_range") > 0)
    )
    turn = F.atan(c(f"{axis}_top_slope")) - F.atan(c(f"{axis}_bottom_slope"))
    return _guard(2, F.when(usable, F.abs(F.degrees(turn))))


def _rough(axis: str) -> Column:
    return _guard(2, F.when(c(f"{axis}_range") > 0, F.sqrt(c(f"{axis}_ms"))))


def _definitions() -> list[FeatureDef]:
    # Keys, classes and types of the features, in output order.
    central, spread, shape, structure, density = "Central tendency", "Spread", "Shape", "Structure", "Density"
    flat = "Horizontal (hand-crafted)"
    defs = [
        FeatureDef("h_mean", "Height", central, "mean height", ("n", "h_avg"), lambda: c("h_avg")),
        FeatureDef("h_median", "Height", central, "median height", ("p50",), lambda: c("p50")),
        FeatureDef("h_max", "Height", central, "largest height", ("h_hi",), lambda: c("h_hi")),
        FeatureDef("h_p25", "Height", central, "25th percentile", ("p25",), lambda: c("p25")),
        FeatureDef("h_p75", "Height", central, "75th percentile", ("p75",), lambda: c("p75")),
        FeatureDef("h_p95", "Height", central, "95th percentile", ("p95",), lambda: c("p95")),
        FeatureDef("h_var", "Height", spread, "sample variance", ("n", "h_vs"), lambda: _guard(2, c("h_vs"))),
        FeatureDef("h_std", "Height", spread, "sample standard deviation", ("n", "h_vs"), lambda: _guard(2, F.sqrt(c("h_vs")))),
        FeatureDef("h_cv", "Height", spread, "standard deviation over mean, mean above 0", ("n", "h_vs", "h_avg"),
                   lambda: _guard(2, F.when(c("h_avg") > 0, F.try_divide(F.sqrt(c("h_vs")), c("h_avg"))))),
        FeatureDef("h_skew", "Height", shape, "biased skewness", ("n", "h_vs", "h_g1"),
                   lambda: _guard(3, F.when(c("h_vs") > 0, c("h_g1")))),
        FeatureDef("h_kurtosis", "Height", shape, "biased excess kurtosis", ("n", "h_vs", "h_g2"),
                   lambda: _guard(4, F.when(c("h_vs") > 0, c("h_g2")))),
        FeatureDef("entropy", "Height", structure, "Shannon entropy of height layers, bits", ("layer_entropy",), lambda: c("layer_entropy")),
        FeatureDef("sigma_z", "Height", structure, "RMS about the fitted plane", ("n", "plane_ms"), lambda: _guard(3, F.sqrt(c("plane_ms")))),
        FeatureDef("frac_above_mean", "Height", density, "share of points above the mean height", ("n", "n_above"),
                   lambda: F.try_divide(c("n_above").cast("double"), c("n").cast("double"))),
        FeatureDef("ppr", "Height", density, "ground points over all points", ("n_all", "n_ground"),
                   lambda: F.try_divide(c("n_ground").cast("double"), c("n_all").cast("double"))),
        FeatureDef("R_mean", "Color", "Colour", "mean red", ("red_avg",), lambda: c("red_avg")),
        FeatureDef("G_mean", "Color", "Colour", "mean green", ("green_avg",), lambda: c("green_avg")),
        FeatureDef("B_mean", "Color", "Colour", "mean blue", ("blue_avg",), lambda: c("blue_avg")),
        FeatureDef("pca_spread_major", "2D", flat, "spread along the long axis", AXES, lambda: _spread("major")),
        FeatureDef("pca_spread_minor", "2D", flat, "spread along the short axis", AXES, lambda: _spread("minor")),
        FeatureDef("pca_anisotropy", "2D", flat, "relative difference of the two spreads", AXES,
                   lambda: F.try_divide(_spread("major") - _spread("minor"), F.nullif(_spread("major") + _spread("minor"), F.lit(0.0)))),
    ]
    for axis in ("major", "minor"):
        # the axis points to the side with more points, so the balance is never negative
        defs.append(FeatureDef(f"asym_{axis}", "2D", flat, f"point imbalance across the {axis} axis", ("n", f"{axis}_pos", f"{axis}_neg"),
                               lambda axis=axis: _guard(2, F.abs(balance_index(c(f"{axis}_pos"), c(f"{axis}_neg"))))))
    for axis in ("major", "minor"):
        uses = ("n", "top_n", "bottom_n", *[f"{axis}_{s}_{k}" for s in ("top", "bottom") for k in ("slope", "range")])
        defs.append(FeatureDef(f"slope_angle_{axis}", "2D", flat, f"angle between top and bottom surface along the {axis} axis", uses,
                               lambda axis=axis: _slope_angle(axis)))
    for axis in ("major", "minor"):
        defs.append(FeatureDef(f"rough_{axis}", "2D", flat, f"RMS about the trend along the {axis} axis", ("n", f"{axis}_range", f"{axis}_ms"),
                               lambda axis=axis: _rough(axis)))
    return defs


FEATURES: dict[str, FeatureDef] = {f.key: f for f in _definitions()}


def register_feature(definition: FeatureDef) -> None:
    """Add a feature after the built-in ones; it joins the same passes."""
    if definition.key in FEATURES:
        raise ValueError(f"feature {definition.key!r} exists")
    FEATURES[definition.key] = definition


# ------------------------------------------------------------------------------------ passes
def prepared_points(points: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The columns features read: ``h`` from the configured channel and the vegetation flag."""
    from plotspark.sources.channels import channel_value

    have = set(points.columns)
    colours = [n for n in (cfg.red, cfg.green, cfg.blue) if n]
    missing = [F.lit(None).cast("double").alias(n) for n in colours if n not in have]
    return points.select(
        "filename", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"),
        channel_value(points, cfg.height).alias("h"), "classification",
        (c("classification") == cfg.veg_code).alias("veg"),
        *[c(n).cast("double").alias(n) for n in colours if n in have], *missing,
    )


def _needs(keys: Sequence[str]) -> tuple[set[str], set[str], set[str], bool]:
    """(base, levels, frame) intermediates and whether the layer pass is needed."""
    used = {u for k in keys for u in FEATURES[k].uses}
    layers = "layer_entropy" in used
    frame = {u for u in used if u in FRAME}
    relative = {need for name in frame for need in FRAME[name][0]}
    base = {u for u in used | relative if u in BASE}
    if frame & {f"{a}_{k}" for a in ("major", "minor") for k in ("pos", "neg", "range", "ms")} or "plane_ms" in frame:
        base |= set(AXES)
    if any(u.endswith(("_ms",)) for u in frame):
        base |= set(PLANE)
    if layers:
        base |= {"h_lo", "h_hi"}
    levels = {u for u in used if u in LEVELS}
    if {"cut_lo", "cut_hi"} & (relative | used):
        levels |= {"cut_lo", "cut_hi"}
    return base, levels, frame, layers


def cloud_values(points: DataFrame, keys: Sequence[str], cfg: FeatureConfig = FeatureConfig(), by: Sequence[str] = ("filename",),
                 extra_frame: Sequence[str] = ()) -> DataFrame:
    """One row per cloud with every intermediate the chosen features read (and ``extra_frame`` ones)."""
    if not 0.0 < cfg.strata_pct < 50.0:
        raise ValueError("strata_pct must lie between 0 and 50")
    by = list(by)
    base, levels, frame, layers = _needs(keys)
    frame |= set(extra_frame)
    for name in extra_frame:
        base |= {n for n in FRAME[name][0] if n in BASE}
        base |= set(PLANE)
        levels |= {n for n in FRAME[name][0] if n.startswith("cut_")}
    pts = prepared_points(points, cfg)
    veg = pts.where(c("veg") & c("h").isNotNull())

    base_aggs = [BASE[name](cfg).alias(name) for name in BASE if name in base or name == "n"]
    base_aggs += [build(cfg).alias(name) for k in keys for name, build in FEATURES[k].aggregates.items()]
    clouds = pts.groupBy(*by).agg(*base_aggs)
    if set(AXES) <= base:
        clouds = axis_columns(clouds)
    if set(PLANE) <= base:
        clouds = plane_columns(clouds)
    if frame or layers:
        # one row per cloud, read by the later passes instead of aggregating the points again
        clouds = clouds.persist(StorageLevel.MEMORY_AND_DISK)

    if levels:
        shares = {n: LEVELS[n] for n in LEVELS if n in levels}
        if "cut_lo" in levels:
            shares |= {"cut_lo": cfg.strata_pct / 100.0, "cut_hi": (100.0 - cfg.strata_pct) / 100.0}
        quantiles = group_quantiles(veg, by, "h", shares, METRIC)
        clouds = clouds.join(quantiles, by, "left")
        if "cut_lo" in levels and frame:
            clouds = clouds.persist(StorageLevel.MEMORY_AND_DISK)

    out = clouds
    if frame:
        rows = salted_join(veg, clouds, by, "n")
        if set(AXES) <= base:
            rows = with_projection(rows)
        second = rows.groupBy(*by).agg(*[FRAME[n][1]().alias(n) for n in FRAME if n in frame])
        out = out.join(second, by, "left")
    if layers:
        rows = salted_join(veg.select(*by, "x", "y", "h"), clouds.select(*by, "h_lo", "h_hi", "n"), by, "n")
        lowest = F.floor(F.least(F.lit(0.0), c("h_lo"))).cast("double")
        rows = rows.withColumn("layer", layer_index(c("h"), lowest, c("h_hi"), cfg.entropy_bin))
        counts = rows.where(c("layer").isNotNull()).groupBy(*by, "layer").agg(F.count(F.lit(1)).alias("k"))
        # -sum(p log2 p) with p = k/N, in one aggregation over the layers
        total = F.sum("k").cast("double")
        weighted = F.sum(c("k") * F.log2(c("k").cast("double")))
        entropy = counts.groupBy(*by).agg((F.log2(total) - weighted / total).alias("layer_entropy"))
        out = out.join(entropy, by, "left")
    return out


def compute_features(points: DataFrame, keys: Sequence[str] | None = None, cfg: FeatureConfig = FeatureConfig(),
                     by: Sequence[str] = ("filename",)) -> DataFrame:
    """``by + features``, one row per cloud; features in registry order whatever order they were asked in."""
    chosen = [k for k in FEATURES if keys is None or k in set(keys)]
    unknown = set(keys or ()) - set(FEATURES)
    if unknown:
        raise KeyError(f"unknown features: {sorted(unknown)}")
    values = cloud_values(points, chosen, cfg, by)
    return values.select(*by, *[FEATURES[k].value().alias(k) for k in chosen])


def slope_planes(points: DataFrame, cfg: FeatureConfig = FeatureConfig(), by: Sequence[str] = ("filename",)) -> DataFrame:
    """Per cloud, axis and stratum: slope of the fitted line and the mean position it passes through."""
    names = [f"{a}_{s}_{k}" for a in ("major", "minor") for s in ("top", "bottom") for k in ("slope", "s0", "h0")]
    values = cloud_values(points, [], cfg, by, extra_frame=names)
    planes = F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.lit(s).alias("stratum"), *[c(f"{a}_{s}_{k}").alias(k) for k in ("slope", "s0", "h0")])
        for a in ("major", "minor") for s in ("top", "bottom")])).alias("_p")
    return values.select(*by, planes).select(*by, "_p.*")


def grouped_feature(points: DataFrame, key: str, summarise, merge, finish, cfg: FeatureConfig = FeatureConfig(),
                    by: Sequence[str] = ("filename",), chunk_points: int = 50_000, fan_in: int = 256) -> DataFrame:
    """A feature only Python can express, reduced as a tree so that no cloud is ever collected into one task.

    ``summarise(pandas frame) -> list[float]`` sees at most about ``chunk_points`` vegetation points,
    ``merge(list of summaries) -> list[float]`` combines about ``fan_in`` summaries at a time, and
    ``finish(summary) -> float`` gives the value.
    """
    import pandas as pd

    by = list(by)
    pts = prepared_points(points, cfg)
    pts = pts.where(c("veg") & c("h").isNotNull())
    size = F.count(F.lit(1))
    sizes = pts.groupBy(*by).agg(F.ceil(size / F.lit(chunk_points)).alias("_chunks"), size.alias("_n"))
    pts = salted_join(pts, sizes, by, "_n")
    pts = pts.withColumn("_chunk", F.pmod(F.xxhash64("x", "y", "h", F.lit(1)), c("_chunks")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pts.schema.fields if f.name in by)

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: [pdf[k].iloc[0]] for k in [*by, "_chunk"]}
        return pd.DataFrame({**row, "summary": [[float(v) for v in summarise(pdf)]]})

    def next_level(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: [pdf[k].iloc[0]] for k in by}
        return pd.DataFrame({**row, "_chunk": [0], "summary": [[float(v) for v in merge(list(pdf["summary"]))]]})

    def last_level(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: [pdf[k].iloc[0]] for k in by}
        return pd.DataFrame({**row, key: [float(finish(merge(list(pdf["summary"]))))]})

    summary_schema = f"{fields}, `_chunk` bigint, summary array<double>"
    level = map_groups(pts, [*by, "_chunk"], first_level, summary_schema)
    level = map_groups(level.withColumn("_part", F.floor(c("_chunk") / fan_in)), [*by, "_part"], next_level, summary_schema)
    return map_groups(level, by, last_level, f"{fields}, `{key}` double")
