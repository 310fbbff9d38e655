"""Plot polygons: one row per mask with closed rings, bounding box and the number read from its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.functions.naming import LabelFormat, label_number

c = F.col

RINGS = "array<array<struct<x:double,y:double>>>"


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end."""
    return F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def with_bounds(masks: DataFrame) -> DataFrame:
    vertices = F.flatten(c("rings"))
    xs, ys = F.transform(vertices, lambda v: v["x"]), F.transform(vertices, lambda v: v["y"])
    return (
        masks.withColumn("minx", F.array_min(xs)).withColumn("maxx", F.array_max(xs))
        .withColumn("miny", F.array_min(ys)).withColumn("maxy", F.array_max(ys))
    )


def masks_from_vertices(vertices: DataFrame) -> DataFrame:
    """Masks from rows (label, seq, x, y[, ring]); a polygon's own vertices are one row by definition."""
    ring = c("ring") if "ring" in vertices.columns else F.lit(0)
    rings = (
        vertices.groupBy("label", ring.alias("ring"))
        .agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
        .withColumn("v", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    )
    masks = rings.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("ring", "v"))).alias("r"))
    masks = masks.select("label", F.transform("r", lambda q: closed(q["v"])).alias("rings"))
    return with_bounds(masks)


GEOJSON_FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"


def features_from_geojson(lines: DataFrame, text: str = "value") -> DataFrame:
    """One GeoJSON feature per line -> ``properties`` and ``rings`` (null geometry stays null)."""
    parsed = lines.select(F.from_json(c(text), GEOJSON_FEATURE).alias("f")).select("f.properties", "f.geometry")
    polygon = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    coordinates = F.when(c("geometry.type") == "Polygon", polygon).when(c("geometry.type") == "MultiPolygon", multi)
    rings = F.transform(coordinates, lambda ring: closed(F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return parsed.select("properties", rings.alias("rings"))


def list_mask_fields(features: DataFrame) -> DataFrame:
    """Attribute names that can carry the label."""
    return features.select(F.explode(F.map_keys("properties")).alias("field")).distinct()


def load_masks(features: DataFrame, label_field: str, fmt: LabelFormat | None = None) -> tuple[DataFrame, DataFrame]:
    """(masks, unreadable labels); rows without geometry are dropped silently."""
    usable = features.where(c("rings").isNotNull() & (F.size("rings") > 0))
    text = F.try_element_at(c("properties"), F.lit(label_field))
    labelled = usable.select(label_number(text, fmt).alias("label"), text.alias("label_text"), "rings", "properties")
    readable = labelled.where(c("label").isNotNull()).drop("label_text")
    return with_bounds(readable), labelled.where(c("label").isNull()).select("label_text")


def read_geojson(spark: SparkSession, path: str, label_field: str, fmt: LabelFormat | None = None) -> tuple[DataFrame, DataFrame]:
    """Newline-delimited GeoJSON features; an unknown field or a file without usable polygons is an error."""
    features = features_from_geojson(spark.read.text(path))
    if features.where(F.map_contains_key("properties", label_field)).isEmpty():
        known = [row["field"] for row in list_mask_fields(features).orderBy("field").limit(100).collect()]
        raise KeyError(f"no label field {label_field!r}; available: {', '.join(known)}")
    masks, unreadable = load_masks(features, label_field, fmt)
    if masks.isEmpty():
        raise ValueError(f"none of the features in {path} is a polygon with a readable label")
    return masks, unreadable
