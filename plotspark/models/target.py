"""Fitting on the log scale and coming back without the bias of a plain exponential."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.functions.scalars import from_log_target
from plotspark.models.design import keyed_join

c = F.col


def to_log(rows: DataFrame, y: str = "y") -> DataFrame:
    """The target on the log scale; values of -1 or less are an error that names their number."""
    bad = rows.where(c(y) <= -1).count()
    if bad:
        raise ValueError(f"log1p is undefined for {bad} row(s): targets must exceed -1")
    return rows.withColumn(y, F.log1p(y))


def smearing(residual: Column) -> Column:
    """Mean of exp(residual) over finite residuals; 1 when that is undefined or not positive."""
    finite = F.when(~F.isnan(residual) & (F.abs(residual) < float("inf")), residual)
    factor = F.avg(F.exp(finite))
    return F.when((factor > 0) & (factor < float("inf")), factor).otherwise(F.lit(1.0))


def smearing_factors(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``smear`` per fold from the fitting rows' log-scale residuals."""
    fitted = F.when(c("fit"), c("y") - c("predicted"))
    return scored.groupBy(*keys).agg(smearing(fitted).alias("smear"))


def smears(scored: DataFrame, keys: Sequence[str], correction: str = "smearing") -> DataFrame:
    """``smear`` per fold as the correction has it: 1 without one."""
    found = smearing_factors(scored, keys)
    return found if correction == "smearing" else found.withColumn("smear", F.lit(1.0))


def from_log(scored: DataFrame, keys: Sequence[str], n_keys: int, correction: str = "smearing") -> DataFrame:
    """Predictions and targets back in original units, floored at 0."""
    scored = keyed_join(scored, smears(scored, keys, correction), keys, n_keys, 1)
    return (
        scored.withColumn("predicted", from_log_target(c("predicted"), c("smear")))
        .withColumn("y", F.expm1("y")).drop("smear")
    )


def describe(transform: str, correction: str = "smearing") -> str:
    if transform != "log":
        return "Target as measured."
    how = "smearing back-transform" if correction == "smearing" else "plain exponential back-transform (biased towards the median)"
    return f"Target on the log scale, {how}; metrics in the target's own units."
