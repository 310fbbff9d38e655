"""Listings of cloud files: natural order, point counts, and the (plot, copy) -> file map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.functions import naming
from plotspark.operators.ranking import ordered_rank

c = F.col

CLOUD_PATTERN = r"(?i)\.(las|laz)$"
SOURCE_PATTERN = r"(?i)\.(las|laz|pcd)$"


def importable(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.where(c(path).rlike(SOURCE_PATTERN))


def list_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all importable files below a folder; only the listing is read, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return importable(files.select("path"))


def natural_order(paths: DataFrame, path: str = "path", out: str = "place") -> DataFrame:
    """Adds the position in natural path order."""
    return ordered_rank(paths.withColumn("_key", naming.natural_key(c(path))), ["_key", path], out).drop("_key")


def point_counts(points: DataFrame, by: str = "filename") -> DataFrame:
    return points.groupBy(by).agg(F.count(F.lit(1)).alias("points"))


def point_summary(counts: DataFrame) -> DataFrame:
    """One row: clouds, points in total and the rounded average per cloud."""
    return counts.agg(F.count(F.lit(1)).alias("clouds"), F.sum("points").alias("points")).select(
        "clouds", "points", F.rint(F.try_divide(c("points"), c("clouds"))).cast("bigint").alias("per_cloud"))


def file_map(paths: DataFrame, path: str = "path", originals_only: bool = False) -> DataFrame:
    """(plot, aug, file): the first path of every plot and copy."""
    named = paths.where(c(path).rlike(CLOUD_PATTERN)).select(
        naming.plot_number(naming.base_name(c(path))).alias("plot"), naming.aug_level(naming.base_name(c(path))).alias("aug"),
        naming.aug_number(naming.base_name(c(path))).alias("_copy"), c(path).alias("path"))
    named = named.where(c("plot").isNotNull())
    if originals_only:
        named = named.where(c("_copy").isNull())
    return named.groupBy("plot", "aug").agg(F.min("path").alias("path")).withColumn("file", naming.base_name(c("path")))


def previous_output(spark: SparkSession, folder: str, manifest_name: str = "augmentation_manifest.csv") -> tuple[DataFrame, bool]:
    """The clouds of an earlier run and whether its manifest is there; an empty folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    clouds = files.where(c("path").rlike(CLOUD_PATTERN))
    if clouds.isEmpty():
        raise FileNotFoundError(f"no clouds in {folder}")
    return clouds, not files.where(naming.base_name(c("path")) == manifest_name).isEmpty()
