"""From a feature table to fold-wise design rows: coercion, groups, median imputation, centring and scaling.

Folds are a column: every statistic is one aggregation over all folds at once, and is fitted on the fold's own
fitting rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.functions import naming
from plotspark.functions.scalars import numeric_or_null
from plotspark.operators.folds import fold_rows
from plotspark.operators.ranking import group_quantiles, salted_join

c = F.col

BROADCAST_BYTES = 64 * 1024 * 1024


def keyed_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], small_rows: int, values_per_row: int) -> DataFrame:
    """Join per-fold values onto rows: broadcast while their known size is small, cut by row counts beyond."""
    if small_rows * (values_per_row * 8 + 64) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), list(keys))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return salted_join(rows, small.join(sizes, list(keys)), list(keys), "_n")


def labelled_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with a numeric target: filename, grp, plot, aug, is_aug, y and numeric features."""
    name = c("filename")
    rows = df.select(
        name, naming.group_label(name).alias("grp"), naming.plot_number(name).alias("plot"), naming.aug_level(name).alias("aug"),
        naming.aug_number(name).isNotNull().alias("is_aug"), numeric_or_null(c(target)).alias("y"),
        *[numeric_or_null(c(f)).alias(f) for f in features])
    return rows.where(c("y").isNotNull())


def with_folds(rows: DataFrame, folds: DataFrame, n_cycles: int, train_aug: bool = True) -> DataFrame:
    """Rows per cycle with ``held_out`` and ``fit`` (the rows the fold's model may see)."""
    sided = fold_rows(rows, folds, n_cycles)
    return sided.withColumn("fit", ~c("held_out") & (F.lit(train_aug) | ~c("is_aug")))


def with_folds_per_key(rows: DataFrame, folds: DataFrame, key: str, train_aug: bool = True) -> DataFrame:
    """As with_folds, for many cross-validations at once; rows carry ``_cycles``, the number of cycles of their key."""
    sizes = rows.groupBy(key, "grp").agg(F.count(F.lit(1)).alias("_n"))
    marked = folds.join(sizes, [key, "grp"]).withColumn("_held", F.lit(True))
    every = rows.withColumn("cycle", F.explode(F.sequence(F.lit(0), c("_cycles") - 1))).drop("_cycles")
    sided = salted_join(every, marked, [key, "cycle", "grp"], "_n", "left")
    sided = sided.withColumn("held_out", F.coalesce(c("_held"), F.lit(False))).drop("_held")
    return sided.withColumn("fit", ~c("held_out") & (F.lit(train_aug) | ~c("is_aug")))


def require_originals(sided: DataFrame, score_aug: bool) -> None:
    """Every fold needs rows to fit on and rows to score."""
    scored = c("held_out") & (F.lit(score_aug) | ~c("is_aug"))
    empty = sided.groupBy("cycle").agg(F.count_if("fit").alias("f"), F.count_if(scored).alias("s")).where((c("f") == 0) | (c("s") == 0))
    if not empty.isEmpty():
        raise ValueError("one side of a fold holds no original row; allow augmented rows or choose another test share")


def medians(sided: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``med``: exact medians of the fitting rows per fold, 0 for an all-null column."""
    long = sided.where("fit").select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), c(f).alias("v")) for i, f in enumerate(features)])).alias("_s"))
    long = long.select(*keys, "_s.i", "_s.v")
    found = group_quantiles(long, [*keys, "i"], "v", {"m": 0.5})
    return _spread(sided, found, keys, features, "m", "med")


def _spread(sided: DataFrame, found: DataFrame, keys: Sequence[str], features: Sequence[str], value: str, out: str) -> DataFrame:
    cycles = sided.select(*keys).distinct()
    wide = found.groupBy(*keys).agg(*[F.max(F.when(c("i") == i, c(value))).alias(f"_m{i}") for i in range(len(features))])
    wide = cycles.join(wide, list(keys), "left")
    return wide.select(*keys, F.array(*[F.coalesce(c(f"_m{i}"), F.lit(0.0)) for i in range(len(features))]).alias(out))


def fit_prep(sided: DataFrame, features: Sequence[str], keys: Sequence[str], n_keys: int, normalize: Sequence[str] | None = None,
             scaled_model: bool = True) -> DataFrame:
    """One row per fold: ``med``, ``mean``, ``scale`` arrays over the features and ``y_mean``.

    ``normalize`` None scales every column, a list scales those, an empty list none; models that need no scaling get
    none. A constant column is divided by 1.
    """
    p = len(features)
    wanted = set(features if normalize is None else normalize) if scaled_model else set()
    med = medians(sided, features, keys)
    filled = keyed_join(sided.where("fit"), med, keys, n_keys, p)
    value = lambda i, f: F.coalesce(c(f), F.get("med", F.lit(i)))
    stats = filled.groupBy(*keys).agg(
        F.first("med").alias("med"), F.avg("y").alias("y_mean"), F.count(F.lit(1)).alias("n_fit"),
        *[F.avg(value(i, f)).alias(f"_a{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(value(i, f)).alias(f"_s{i}") for i, f in enumerate(features)],
        *[(F.max(value(i, f)) > F.min(value(i, f))).alias(f"_v{i}") for i, f in enumerate(features)])
    scale = [F.when(c(f"_v{i}"), c(f"_s{i}")).otherwise(F.lit(1.0)) if f in wanted else F.lit(1.0) for i, f in enumerate(features)]
    return stats.select(
        *keys, "med", F.array(*[c(f"_a{i}") for i in range(p)]).alias("mean"), F.array(*scale).alias("scale"), "y_mean", "n_fit")


def scaled_features(features: Sequence[str]) -> Column:
    """The imputed, centred and scaled feature vector of a row that carries its fold's prep columns."""
    return F.array(*[
        (F.coalesce(c(f), F.get("med", F.lit(i))) - F.get("mean", F.lit(i))) / F.get("scale", F.lit(i))
        for i, f in enumerate(features)])


def design_rows(sided: DataFrame, prep: DataFrame, features: Sequence[str], keys: Sequence[str], n_keys: int, cache: bool = True) -> DataFrame:
    """Rows with ``x`` (prepared features) and ``y_mean``; read once for fitting and once for scoring."""
    joined = keyed_join(sided, prep, keys, n_keys, 3 * len(features) + 2)
    out = joined.withColumn("x", scaled_features(features)).drop("med", "mean", "scale", *features)
    return out.persist(StorageLevel.MEMORY_AND_DISK) if cache else out


def dot(x: str, w: str, size: int) -> Column:
    """Inner product of two array columns, unrolled so that it stays inside generated code."""
    if size > 256:
        return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    total = F.lit(0.0)
    for i in range(size):
        total = total + F.get(x, F.lit(i)) * F.get(w, F.lit(i))
    return total
