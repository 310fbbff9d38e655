"""Reference sheets meet clouds: row filters, first-match lookup, one-hot columns, match reports, the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.config import FeatureConfig
from plotspark.functions import naming
from plotspark.operators.features import compute_features
from plotspark.operators.keys import ReferenceSheet

c = F.col

MAX_DUMMIES = 100  # fixed value: one-hot columns allowed in one table


def trimmed(column: str):
    return F.trim(c(column).cast("string"))


def column_values(sheet: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-null values of a column (for choosing a row filter)."""
    return sheet.where(c(column).isNotNull()).select(trimmed(column).alias("value")).distinct()


def keep_rows(sheet: DataFrame, column: str | None, value: str | None) -> DataFrame:
    """Rows whose trimmed text equals the trimmed value; no filter when column or value is blank or absent."""
    if not column or value is None or value == "" or column not in sheet.columns:
        return sheet
    kept = sheet.where(trimmed(column) == str(value).strip())
    if kept.isEmpty():
        present = [r["value"] for r in column_values(sheet, column).orderBy("value").limit(10).collect()]
        raise ValueError(f"{column} never equals {str(value).strip()!r}; it holds {', '.join(present)}")
    return kept


def resolve_columns(universe: Sequence[str], enabled: Sequence[str] = (), disabled: Sequence[str] = (), default_on: bool = True) -> list[str]:
    """A whitelist wins, else everything but the blacklist; order of the universe is kept."""
    if not enabled and not disabled and not default_on:
        return []
    allowed = set(enabled) or set(universe) - set(disabled)
    return [n for n in universe if n in allowed]


def first_rows(sheet: ReferenceSheet, columns: Sequence[str]) -> DataFrame:
    """One row per plot: the first in sheet order (combined map-side, so a key may have any number of rows)."""
    first = sheet.frame.groupBy("plot").agg(F.min_by(F.struct(*columns), sheet.order).alias("_r"))
    return first.select("plot", *[c(f"_r.{n}").alias(n) for n in columns])


def lookup(files: DataFrame, sheet: ReferenceSheet, columns: Sequence[str], plot: str = "plot") -> DataFrame:
    """The sheet's columns for every file; null when the plot number is missing or not in the sheet."""
    first = first_rows(sheet, columns).withColumnRenamed("plot", "_plot")
    return files.join(first, files[plot] == c("_plot"), "left").drop("_plot")


def categories(sheet: ReferenceSheet, column: str, limit: int = MAX_DUMMIES) -> list:
    """Sorted distinct values of the whole sheet; reads at most ``limit + 1`` of them to the driver."""
    rows = sheet.frame.where(c(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
    return sorted(r[0] for r in rows)


def one_hot(table: DataFrame, sheet: ReferenceSheet, columns: Sequence[str]) -> DataFrame:
    """Replace each column in place by one 1.0/0.0 column per category; null stays null in all of them."""
    found = {n: categories(sheet, n) for n in columns}
    if sum(len(v) for v in found.values()) > MAX_DUMMIES:
        raise ValueError(f"one-hot encoding {', '.join(columns)} gives more than {MAX_DUMMIES} columns")
    out = []
    for name in table.columns:
        if name not in found:
            out.append(c(name))
        for value in found.get(name, ()):
            out.append(F.when(c(name).isNotNull(), (c(name) == F.lit(value)).cast("double")).alias(f"{name}={value}"))
    return table.select(*out)


def match_report(plots: DataFrame, sheet: ReferenceSheet) -> DataFrame:
    """One row: sheet size, duplicate keys, and how many of the plots found a row."""
    numbers = plots.select("plot").where(c("plot").isNotNull()).distinct()
    matched = numbers.join(sheet.frame.select("plot"), "plot", "left_semi")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return sheet.frame.agg(F.count(F.lit(1)).alias("sheet_rows")).select(
        "sheet_rows", F.lit(len(sheet.columns)).alias("sheet_columns"), count(sheet.duplicate_keys).alias("duplicate_keys"),
        count(numbers).alias("plots"), count(matched).alias("matched"), (count(numbers) - count(matched)).alias("unmatched"),
    )


def unmatched_plots(plots: DataFrame, sheet: ReferenceSheet) -> DataFrame:
    numbers = plots.select("plot").where(c("plot").isNotNull()).distinct()
    return numbers.join(sheet.frame.select("plot"), "plot", "left_anti")


@dataclass(frozen=True)
class FeatureTables:
    """Features and targets keyed by file name, and the clouds that could not be used."""

    x: DataFrame
    y: DataFrame | None
    failures: DataFrame


def feature_tables(points: DataFrame, keys: Sequence[str] | None = None, sheet: ReferenceSheet | None = None,
                   columns: Sequence[str] = (), encode: Sequence[str] = (), target: str | None = None,
                   cfg: FeatureConfig = FeatureConfig()) -> FeatureTables:
    """The whole feature run: cloud features, reference columns, dummies; the target goes to its own table."""
    from plotspark.sources.channels import missing_channel

    failures = missing_channel(points, cfg.height)
    usable = points.join(failures.select("filename"), "filename", "left_anti") if "extra" in points.columns else points
    x = compute_features(usable, keys, cfg)
    y = None
    if sheet is not None:
        files = x.withColumn("_p", naming.plot_number(c("filename")))
        wanted = [n for n in columns if n != target]
        x = lookup(files, sheet, wanted, "_p").drop("_p") if wanted else x
        x = one_hot(x, sheet, [n for n in encode if n in wanted]) if encode else x
        if target is not None:  # from the names alone, so that the features are not computed again
            names = usable.select("filename").distinct().withColumn("_p", naming.plot_number(c("filename")))
            y = lookup(names, sheet, [target], "_p").drop("_p")
    return FeatureTables(x, y, failures)


def join_target(x: DataFrame, y: DataFrame) -> DataFrame:
    """Features with the first target column, joined on file name."""
    target = [n for n in y.columns if n != "filename"][0]
    return x.join(y.select("filename", target), "filename", "left")
