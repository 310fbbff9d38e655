"""Analytics over long prediction and metric tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotspark.functions.aggregates import intercept, pearson, slope
from plotspark.functions.scalars import error_pct
from plotspark.operators import metrics as mt
from plotspark.operators.features import FEATURES
from plotspark.operators.folds import grouped_split, groups_of
from plotspark.operators.ranking import attach, count_below, group_quantiles

c = F.col

SCOPES = ("held_out", "train", "delta", "overall")


# -------------------------------------------------------------------------------- plot tables
def plot_table(predictions: DataFrame, train_groups: DataFrame, by: str = "plot") -> DataFrame:
    """Adds error_pct and the role: 'T' for rows of the training plots, else 'V'."""
    members = train_groups.select(by).distinct().withColumn("_t", F.lit(True))
    rows = predictions.join(members, by, "left")
    return rows.withColumn("error_pct", error_pct(c("actual"), c("predicted"))).withColumn(
        "role", F.when(c("_t"), F.lit("T")).otherwise(F.lit("V"))).drop("_t")


def map_rows(file_map: DataFrame, features: DataFrame, level: int, predictions: DataFrame | None = None) -> DataFrame:
    """One row per plot at an augmentation level with its features; without predictions the error stays null."""
    names = [n for n in features.columns if n != "filename"]
    files = file_map.where(c("aug") == level).select("plot", c("file").alias("filename"))
    if predictions is not None:
        rows = predictions.where(c("aug") == level).select("plot", "error_pct", "role").join(files, "plot", "left")
    else:
        rows = files.select("plot", F.lit(None).cast("double").alias("error_pct"), F.lit("").alias("role"), "filename")
    return rows.join(features, "filename", "left").select("plot", "error_pct", "role", *names)


def role_series(predictions: DataFrame, role: str, with_aug: bool) -> DataFrame:
    return predictions.where((c("role") == role) & (F.lit(with_aug) | (c("aug") == 0)))


def pooled_held_out(predictions: DataFrame, with_aug: bool) -> DataFrame:
    """Every split's held-out rows together."""
    return role_series(predictions, "V", with_aug)


# ------------------------------------------------------------------------------ across splits
def mean_metrics(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of each standard metric over splits; missing and infinite values are left out."""
    finite = lambda n: F.avg(F.when(F.abs(c(n)) < float("inf"), c(n))).alias(n)
    return metrics.groupBy(*keys).agg(*[finite(n) for n in mt.STANDARD])


def fold_spread(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    held = metrics.where(c("scope") == "held_out")
    return held.groupBy(*keys).agg(F.avg("rrmse").alias("mean_rrmse"), F.stddev_pop("rrmse").alias("std_rrmse"))


def consistency_series(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, split, kind, metric, value) for held_out, train, overall and delta = held_out - train."""
    long = cells.select(*keys, "split", "scope", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), c(m).alias("value")) for m in mt.STANDARD])).alias("_m"))
    long = long.select(*keys, "split", "scope", "_m.metric", "_m.value")
    pick = lambda scope: F.max(F.when(c("scope") == scope, c("value")))
    wide = long.groupBy(*keys, "split", "metric").agg(pick("held_out").alias("h"), pick("train").alias("t"), pick("overall").alias("o"))
    kinds = {"held_out": c("h"), "train": c("t"), "delta": c("h") - c("t"), "overall": c("o")}
    return wide.select(*keys, "split", "metric", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("_k")).select(
        *keys, "split", "_k.kind", "metric", "_k.value")


def consistency_summary(series: DataFrame, keys: Sequence[str], split: int | None = None) -> DataFrame:
    """Mean and spread (population form) per kind and metric over splits, or the one split's values."""
    rows = series if split is None else series.where(c("split") == split)
    return rows.groupBy(*keys, "kind", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def generalisation_gap(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean held-out minus mean train per metric, each side averaged over its own finite values."""
    def side(scope: str, m: str) -> Column:
        return F.avg(F.when((c("scope") == scope) & (F.abs(c(m)) < float("inf")), c(m)))
    return cells.groupBy(*keys).agg(*[(side("held_out", m) - side("train", m)).alias(f"{m}_gap") for m in mt.STANDARD])


def best_splits(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest held-out rRMSE per run, first split on ties; splits without a finite value never win."""
    held = metrics.where(c("scope") == "held_out") if "scope" in metrics.columns else metrics
    return held.groupBy(*keys).agg(mt.lowest("split", "rrmse").alias("best_split"), F.min(mt.finite("rrmse")).alias("best_rrmse"))


def active_splits(metrics: DataFrame, keys: Sequence[str], wanted: Column) -> DataFrame:
    """The wanted split of every run, else its best, else its first."""
    best = best_splits(metrics, keys)
    there = metrics.groupBy(*keys).agg(F.collect_set("split").alias("_have"), F.min("split").alias("_first")).join(best, list(keys), "left")
    pick = F.when(F.array_contains("_have", wanted), wanted).otherwise(F.coalesce("best_split", "_first"))
    return there.select(*keys, pick.alias("split"))


def fit_line(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slope and intercept of predicted on actual with the series' metrics; null when the actuals do not vary."""
    varies = (F.count("actual") >= 2) & (F.min("actual") < F.max("actual"))
    p, y = c("predicted"), c("actual")
    return predictions.groupBy(*keys).agg(
        F.when(varies, slope(p, y)).alias("slope"), F.when(varies, intercept(p, y)).alias("intercept"), *mt.metric_columns())


# --------------------------------------------------------------------------------- comparison
def model_values(cells: DataFrame, keys: Sequence[str], metric: str, best: DataFrame | None = None) -> DataFrame:
    """(keys, kind, value): one bar height per model and kind, the mean over splits or the best split's cell."""
    series = consistency_series(cells, keys).where(c("metric") == metric)
    if best is not None:
        series = series.join(best.select(*keys, c("best_split").alias("split")), [*keys, "split"])
    finite = F.when(F.abs(c("value")) < float("inf"), c("value"))
    return series.groupBy(*keys, "kind").agg(F.avg(finite).alias("value"))


def combined_bars(values: DataFrame, members: DataFrame, combine: str = "avg") -> DataFrame:
    """Bars that combine several models: ``members`` maps (bar, model); values without a number are left out."""
    reduce = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[combine]
    return members.join(values, "model").groupBy("bar", "kind").agg(reduce("value").alias("value"))


def mixed_targets(runs: DataFrame) -> DataFrame:
    """One row: how many different targets the compared runs have, and whether that is more than one."""
    return runs.where(c("target").isNotNull() & (c("target") != "")).agg(F.count_distinct("target").alias("targets")).select(
        "targets", (c("targets") > 1).alias("mixed"))


def shared_range(values: DataFrame) -> DataFrame:
    """One row (low, high) around all values, including 0, padded by 5 %."""
    low, high = F.least(F.lit(0.0), F.min("value")), F.greatest(F.lit(0.0), F.max("value"))
    spans = values.where(c("value").isNotNull()).agg(low.alias("lo"), high.alias("hi"), F.count("value").alias("n")).where(c("n") > 0)
    pad = F.coalesce(F.nullif((c("hi") - c("lo")) * 0.05, F.lit(0.0)), F.lit(1.0))
    return spans.select((c("lo") - F.when(c("lo") < 0, pad).otherwise(F.lit(0.0))).alias("low"), (c("hi") + pad).alias("high"))


def bar_order(values: DataFrame, mode: str, position: str = "position") -> DataFrame:
    """Adds ``place``: as given, ascending or descending; bars without a value last in their given order."""
    by = [c(position)] if mode == "none" else [
        c("value").isNull(), c("value").desc() if mode == "desc" else c("value").asc(), c(position).desc() if mode == "desc" else c(position)]
    if mode != "none":
        by = [c("value").isNull(), F.when(c("value").isNull(), c(position)), *by[1:]]
    return values.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # one row per bar


# ------------------------------------------------------------------------------- parameters
def parameter_stability(fold_params: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, median and maximum of every numeric parameter over folds."""
    group = [*keys, "param"]
    spread = fold_params.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return spread.join(group_quantiles(fold_params, group, "value", {"median": 0.5}), group).select(*group, "low", "median", "high")


# -------------------------------------------------------------------------------- map fields
def z_scores(df: DataFrame, value: str, out: str = "z") -> DataFrame:
    """Distance from the mean in population standard deviations; null without spread."""
    stats = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    spread = stats.select(F.when(c("hi") > c("lo"), c("s"))).scalar()
    return df.withColumn(out, (c(value) - stats.select("m").scalar()) / spread)


def percentile_ranks(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Share of values strictly below, in percent."""
    ranked = count_below(df, [], value, "_below", "_total")
    return ranked.withColumn(out, F.try_divide(c("_below"), c("_total")) * 100.0).drop("_below", "_total")


def range_norm(df: DataFrame, value: str, out: str = "norm") -> DataFrame:
    """Position between the smallest and largest value of all plots; a range of zero is widened by 1."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = span.select(F.when(c("hi") <= c("lo"), F.lit(1.0)).otherwise(c("hi") - c("lo"))).scalar()
    return df.withColumn(out, (c(value) - span.select("lo").scalar()) / width)


# ------------------------------------------------------------------------------ distributions
def distribution(values: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population spread, quartiles, 1.5 IQR whiskers and the number of fliers per group."""
    keys = list(keys)
    rows = values.where(c(value).isNotNull())
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.stddev_samp(value).alias("sd_samp"),
        F.min(value).alias("low"), F.max(value).alias("high"))
    quartiles = group_quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).persist(StorageLevel.MEMORY_AND_DISK)
    iqr = c("q3") - c("q1")
    fences = quartiles.withColumn("_lo", c("q1") - 1.5 * iqr).withColumn("_hi", c("q3") + 1.5 * iqr)
    # Equal values are counted once, so the rows that meet the fences are already combined.
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    fenced = attach(counted, fences.select(*keys, "_lo", "_hi"), keys)
    reached = fenced.groupBy(*keys).agg(
        F.min(F.when(c(value) >= c("_lo"), c(value))).alias("whisker_low"), F.max(F.when(c(value) <= c("_hi"), c(value))).alias("whisker_high"),
        F.sum(F.when(c(value).between(c("_lo"), c("_hi")), 0).otherwise(c("_w"))).alias("fliers"))
    out = attach(attach(facts, quartiles, keys), reached, keys)
    return out.withColumn("whisker_low", F.least("whisker_low", "q1")).withColumn("whisker_high", F.greatest("whisker_high", "q3"))


def normal_curve(facts: DataFrame, points: int = 200) -> DataFrame:
    """A fitted normal curve on an even grid over four standard deviations each side."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    grid = facts.where(c("sd") > 0).select("*", i)
    x = c("mean") - 4.0 * c("sd") + c("i") * (8.0 * c("sd") / (points - 1))
    z = (x - c("mean")) / c("sd")
    return grid.withColumn("x", x).withColumn("density", F.exp(-0.5 * z * z) / (c("sd") * F.sqrt(F.lit(2.0) * F.pi())))


def kernel_density(values: DataFrame, value: str, facts: DataFrame, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid from the smallest to the largest value.

    Equal values are counted first; every distinct value then adds its kernel to the fixed grid, combined map-side.
    """
    fact = facts.where(c("high") > c("low")).first()  # one row
    if fact is None:
        return values.sparkSession.createDataFrame([], "i int, x double, density double")
    low, step, width = fact["low"], (fact["high"] - fact["low"]) / (points - 1), fact["n"] ** -0.2 * fact["sd_samp"]
    counted = values.where(c(value).isNotNull()).groupBy(c(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    grid = counted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(low) + c("i") * F.lit(step))
    kernel = c("w") * F.exp(-0.5 * F.pow((c("x") - c("v")) / F.lit(width), 2))
    norm = fact["n"] * width * math.sqrt(2.0 * math.pi)
    return grid.groupBy("i").agg(F.max("x").alias("x"), (F.sum(kernel) / F.lit(norm)).alias("density"))


# --------------------------------------------------------------------------------- columns
def grouped_columns(df: DataFrame) -> DataFrame:
    """Column names (``column``, ``position``) ordered as the registry groups them, unknown ones last."""
    known = df.sparkSession.createDataFrame(
        [(k, f.cls, f.group, i) for i, (k, f) in enumerate(FEATURES.items())], "column string, cls string, type string, ord int")
    placed = df.join(F.broadcast(known), "column", "left")  # the registry has a fixed size
    order = Window.orderBy(c("ord").isNull(), "ord", "position")  # one row per column of a table
    return placed.select(
        "column", F.coalesce("cls", F.lit("Imported / other")).alias("cls"), F.coalesce("type", F.lit("")).alias("type"),
        F.row_number().over(order).alias("place"))


def feature_preview(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Minimum, maximum and direct correlation with the target per feature, over complete pairs."""
    long = rows.select(c(target).alias("t"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), c(f).cast("double").alias("v")) for f in features])).alias("_f")).select("t", "_f.feature", "_f.v")
    return long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"), pearson(c("t"), c("v")).alias("direct_r"))


def training_preview(rows: DataFrame, features: Sequence[str], test_size: float, seed: int, include_aug: bool) -> DataFrame:
    """The feature preview on the training side of one random grouped split.

    ``rows``: grp, is_aug, y and the features. Too few groups to split, or no original row left, means all rows.
    """
    groups = groups_of(rows)
    train = rows
    if groups.limit(2).count() == 2:
        train = rows.join(grouped_split(groups, "random", test_size, seed), "grp", "left_anti")
    originals = train.where(~c("is_aug"))
    if not include_aug and not originals.isEmpty():
        train = originals
    return feature_preview(train, features, "y")


def values_as_text(values: DataFrame, unit: str = "", as_table: bool = False, with_average: bool = False) -> DataFrame:
    """One row ``text``: the chart's values (label, value, position) as a line or as tab-separated rows."""
    from plotspark.functions.scalars import general_format

    shown = lambda v: F.coalesce(general_format(v, 4), F.lit("n/a"))
    number = F.when(c("value").isNull() | F.isnan("value"), F.lit(None).cast("double")).otherwise(c("value"))
    rows = values.withColumn("value", number)
    tail = F.lit(f" {unit}" if unit else "")
    cell = lambda v: F.when(v.isNull(), F.lit("n/a")).otherwise(F.concat(shown(v), tail))
    line = F.concat("label", F.lit("\t"), shown(c("value"))) if as_table else F.concat("label", F.lit(": "), cell(c("value")))
    glue = "\n" if as_table else ", "
    # a chart holds one row per bar
    text = rows.agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"), F.avg("value").alias("_avg"))
    joined = F.array_join(F.transform("_l", lambda s: s["line"]), glue)
    if as_table and unit:
        joined = F.concat(F.lit(f"\t{unit}\n"), joined)
    if with_average:
        last = F.concat(F.lit("Average\t"), shown(c("_avg"))) if as_table else F.concat(F.lit("Average: "), cell(c("_avg")))
        joined = F.concat(joined, F.lit(glue), last)
    return text.select(joined.alias("text"))
