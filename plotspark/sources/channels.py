"""Picking a per-point channel by name: a coordinate, a named column or an extra dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_value(points: DataFrame, channel: str) -> Column:
    """The channel as double; axis names are accepted in either case; NaN becomes null."""
    columns = {name.lower(): name for name in points.columns}
    if channel in points.columns:
        value = F.col(channel).cast("double")
    elif channel.lower() in ("x", "y", "z") and channel.lower() in columns:
        value = F.col(columns[channel.lower()]).cast("double")
    elif "extra" in points.columns:
        value = F.try_element_at(F.col("extra"), F.lit(channel)).cast("double")
    else:
        raise KeyError(f"no channel {channel!r}; available: {', '.join(points.columns)}")
    return F.when(~F.isnan(value), value)


def channel_listing(points: DataFrame) -> DataFrame:
    """Every dimension name with the number of clouds that carry it."""
    fixed = [n for n in points.columns if n not in ("filename", "plot", "aug", "point_id", "extra")]
    per_cloud = points.groupBy("filename").agg(*[F.count(n).alias(n) for n in fixed])
    present = F.explode(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in fixed])).alias("dimension")
    pairs = per_cloud.select("filename", present).where(F.col("dimension").isNotNull())
    if "extra" in points.columns:
        extras = points.select("filename", F.map_keys("extra").alias("names")).distinct()
        pairs = pairs.unionByName(extras.select("filename", F.explode("names").alias("dimension")).distinct())
    return pairs.groupBy("dimension").agg(F.count(F.lit(1)).alias("clouds"))


def missing_channel(points: DataFrame, channel: str) -> DataFrame:
    """The failures of a run: clouds in which no point carries the height channel, with what they do carry."""
    names = [n for n in points.columns if n not in ("filename", "plot", "aug", "point_id", "extra")]
    value = channel_value(points, channel)
    has_extra = "extra" in points.columns
    aggs = [F.count(value).alias("_have")] + [F.count(n).alias(f"_n_{n}") for n in names]
    per_cloud = points.groupBy("filename").agg(*aggs)
    listed = F.concat_ws(", ", *[F.when(F.col(f"_n_{n}") > 0, F.lit(n)) for n in names])
    failed = per_cloud.where(F.col("_have") == 0).select("filename", listed.alias("available"))
    if has_extra:
        extras = (
            points.where(F.col("extra").isNotNull()).select("filename", F.explode(F.map_keys("extra")).alias("name")).distinct()
            .groupBy("filename").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("extras"))
        )
        failed = failed.join(extras, "filename", "left").select(
            "filename", F.concat_ws(", ", "available", "extras").alias("available"))
    return failed.select("filename", F.concat(F.lit(f"height channel '{channel}' not found; available: "), "available").alias("reason"))
