"""Two-variable aggregates that give null, not an error, when a side does not vary (also under ANSI arithmetic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _paired(y: Column, x: Column) -> tuple[Column, Column]:
    return F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x over complete pairs."""
    py, px = _paired(y, x)
    return F.try_divide(F.covar_pop(py, px), F.var_pop(px))


def intercept(y: Column, x: Column) -> Column:
    py, px = _paired(y, x)
    return F.avg(py) - slope(y, x) * F.avg(px)


def pearson(y: Column, x: Column) -> Column:
    """Correlation over complete pairs; null for fewer than two or a constant side."""
    py, px = _paired(y, x)
    varies = (F.count(py) >= 2) & (F.min(py) < F.max(py)) & (F.min(px) < F.max(px))
    return F.when(varies, F.try_divide(F.covar_pop(py, px), F.stddev_pop(py) * F.stddev_pop(px)))
