"""Reference sheets: CSV or Parquet tables with one row per plot (and perhaps per scan date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def filled_columns(df: DataFrame) -> DataFrame:
    """(column, filled): non-null cells per column, blanks and NaN counting as empty; one pass over the sheet."""
    def present(name: str, kind: str):
        value = c(name)
        if kind in ("double", "float"):
            return F.count(F.when(~F.isnan(value), value))
        if kind == "string":
            return F.count(F.when(value != "", value))
        return F.count(value)

    counts = df.agg(*[present(f.name, f.dataType.typeName()).alias(f.name) for f in df.schema.fields])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column"), c(n).alias("filled")) for n in df.columns])).alias("_c")).select("_c.*")


def drop_blank_columns(df: DataFrame, keep: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """The sheet without all-empty columns; a sheet needs a key and at least one data column."""
    filled = {r["column"] for r in filled_columns(df).where(c("filled") > 0).collect()}  # one row per column
    kept = [n for n in df.columns if n in filled or n in keep]
    if len([n for n in kept if n not in keep]) < 2:
        raise ValueError("fewer than two columns hold values: a sheet is a key and something to look up")
    return df.select(*kept)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (with header) or Parquet sheet; ``row_no`` keeps the sheet order so that 'first row' has a meaning."""
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    place = F.struct(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return drop_blank_columns(raw.withColumn("row_no", place))


def list_reference_columns(spark: SparkSession, path: str) -> list[str]:
    """Header names without all-blank columns."""
    return [n for n in read_reference(spark, path).columns if n != "row_no"]
