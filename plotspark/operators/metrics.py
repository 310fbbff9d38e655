"""Regression metrics as aggregates, and the cube of metrics over scopes and augmented-row choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.functions.aggregates import pearson

c = F.col

STANDARD = ("rrmse", "r2", "r", "mape")  # the reported set; mae and n go along
EPS = 2.220446049250313e-16  # fixed value: smallest denominator of the percentage error


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, 2)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rrmse(y: Column, p: Column) -> Column:
    """RMSE in percent of |mean|; infinite when the mean is zero."""
    mean = F.abs(F.avg(y))
    return F.when(mean == 0, F.lit(float("inf"))).otherwise(F.try_divide(rmse(y, p), mean) * 100.0)


def r2(y: Column, p: Column) -> Column:
    """1 - residual over total squares; a constant target scores 1 when met exactly, else 0."""
    residual, total = F.sum(F.pow(y - p, 2)), F.var_pop(y) * F.count(y)
    constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.count(y) >= 2, F.when(F.min(y) == F.max(y), constant).otherwise(1.0 - F.try_divide(residual, total)))


def r(y: Column, p: Column) -> Column:
    """Pearson correlation; null for fewer than two points or a constant side."""
    return pearson(y, p)


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS))) * 100.0


def finite(name: str) -> Column:
    """The column's value where it is a finite number."""
    return F.when(F.abs(c(name)) < float("inf"), c(name))


def lowest(pick: Column | str, value: str, tie: str = "split") -> Column:
    """Aggregate: ``pick`` of the row with the lowest finite value, the smaller ``tie`` first; null where no row has one."""
    return F.min_by(pick, F.when(finite(value).isNotNull(), F.struct(value, tie)))


def metric_columns(actual: str = "actual", predicted: str = "predicted") -> list[Column]:
    y, p = c(actual), c(predicted)
    return [
        rrmse(y, p).alias("rrmse"), r2(y, p).alias("r2"), r(y, p).alias("r"), mape(y, p).alias("mape"),
        mae(y, p).alias("mae"), F.count(y).alias("n"),
    ]


def standard_metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """rrmse, r2, r, mape, mae and n per group, in one aggregation."""
    return df.groupBy(*keys).agg(*metric_columns(actual, predicted))


def cube_cells(held_out: Column, augmented: Column) -> Column:
    """The cells a prediction row counts in, as an array of (scope, variant).

    Cells overlap: an original held-out row is in both held-out cells and in all four overall cells.
    """
    cell = lambda when, scope, variant: F.when(when, F.struct(F.lit(scope).alias("scope"), F.lit(variant).alias("variant")))
    cells = [
        cell(held_out & ~augmented, "held_out", "orig_only"), cell(held_out, "held_out", "with_aug"),
        cell(~held_out & ~augmented, "train", "orig_only"), cell(~held_out, "train", "with_aug"),
    ]
    for train in (False, True):
        for score in (False, True):
            counted = (~held_out & (F.lit(train) | ~augmented)) | (held_out & (F.lit(score) | ~augmented))
            cells.append(cell(counted, "overall", f"{'aug' if train else 'orig'}_{'aug' if score else 'orig'}"))
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def metric_cube(df: DataFrame, keys: Sequence[str], held_out: Column, augmented: Column,
                actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Standard metrics per ``keys``, scope and variant."""
    rows = df.withColumn("_cell", F.explode(cube_cells(held_out, augmented)))
    rows = rows.withColumn("scope", c("_cell.scope")).withColumn("variant", c("_cell.variant"))
    return standard_metrics(rows, [*keys, "scope", "variant"], actual, predicted)


def variant_of(scope: str, train_aug: bool, score_aug: bool) -> str:
    """The variant two augmented-row switches select in a scope."""
    if scope == "overall":
        return f"{'aug' if train_aug else 'orig'}_{'aug' if score_aug else 'orig'}"
    return "with_aug" if (score_aug if scope == "held_out" else train_aug) else "orig_only"


def cube_lookup(cube: DataFrame, keys: Sequence[str], scope: str, variant: str, fallback: DataFrame | None = None) -> DataFrame:
    """One cell per group; groups without it take the stored metrics of that scope when there are any."""
    cell = cube.where((c("scope") == scope) & (c("variant") == variant))
    if fallback is None or scope == "overall":
        return cell
    stored = fallback.where(c("scope") == scope).join(cell.select(*keys), list(keys), "left_anti")
    return cell.unionByName(stored.withColumn("variant", F.lit(variant)))


def selected_cells(cube: DataFrame, train_aug: bool, score_aug: bool) -> DataFrame:
    """The three cells the two switches select."""
    wanted = F.lit(False)
    for scope in ("held_out", "train", "overall"):
        wanted = wanted | ((c("scope") == scope) & (c("variant") == variant_of(scope, train_aug, score_aug)))
    return cube.where(wanted)
