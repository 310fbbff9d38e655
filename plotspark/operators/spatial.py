"""Geometry of plots: point-in-polygon join, footprints, grid placement and field layouts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.operators.groups import map_groups
from plotspark.operators.ranking import METRIC, group_quantiles, ordered_rank, salted_join
from plotspark.session import checkpointed

c = F.col

#: Masks of up to so many bytes are sent to the points.
BROADCAST_BYTES = 64 * 1024 * 1024
SMALLEST_CELL = 1e-3  # metres; masks without an extent are gridded as if they had this one

# ----------------------------------------------------------------------------- point in polygon
def ring_edges(rings: Column) -> Column:
    """Every edge of every closed ring as struct(x1, y1, x2, y2)."""
    def edges(ring: Column) -> Column:
        return F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return F.flatten(F.transform(rings, edges))


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule over all rings (holes included); a point on an edge is outside."""
    def crosses(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False))

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def points_in_masks(points: DataFrame, masks: DataFrame, label: str = "label") -> DataFrame:
    """Points with the label of every mask that strictly contains them.

    Every mask lies on a grid whose cells, a power of two wide, are at least as large as the mask, so it meets four cells at most, however
    different the masks' sizes are. A point takes its cell on each of the grids in use, and the join is an equi-join on grid and cell. The masks'
    edges are counted: few of them are broadcast, so that no point moves, and beyond that crowded cells are cut by their number of points. The
    exact test runs only on points inside a mask's bounding box.
    """
    extent = F.greatest(c("maxx") - c("minx"), c("maxy") - c("miny"), F.lit(SMALLEST_CELL))
    graded = masks.withColumn("_grid", F.ceil(F.log2(extent)).cast("int"))
    grids = sorted(r["_grid"] for r in graded.where(c("_grid").isNotNull()).select("_grid").distinct().collect())  # one row per power of two
    width = F.pow(F.lit(2.0), c("_grid"))

    def span(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(c(lo) / width), F.floor(c(hi) / width)))

    cells = (
        graded.select(c("label").alias(label), ring_edges(c("rings")).alias("_edges"), "minx", "maxx", "miny", "maxy", "_grid")
        .withColumn("_cx", span("minx", "maxx")).withColumn("_cy", span("miny", "maxy"))
    )
    placed = points.withColumn("_grid", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>")))
    placed = placed.withColumn("_cx", F.floor(c("x") / width)).withColumn("_cy", F.floor(c("y") / width))
    on = ["_grid", "_cx", "_cy"]
    held = cells.agg(F.sum(F.size("_edges") * 32 + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        found = placed.join(F.broadcast(cells), on)
    else:
        found = salted_join(placed, cells.join(placed.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on), on, "_n")
    found = found.where(c("x").between(c("minx"), c("maxx")) & c("y").between(c("miny"), c("maxy")))
    found = found.where(strictly_inside(c("x"), c("y"), c("_edges")))
    return found.drop("_grid", "_cx", "_cy", "_edges", "minx", "maxx", "miny", "maxy")


def empty_masks(masks: DataFrame, clipped: DataFrame, label: str = "label") -> DataFrame:
    """Labels of masks without any point inside."""
    return masks.select(c("label").alias(label)).distinct().join(clipped.select(label).distinct(), label, "left_anti")


# ---------------------------------------------------------------------------------- footprints
def trim_outliers(points: DataFrame, by: Sequence[str] = ("plot",), lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Points within the percentile band on both axes; groups under 20 points, or left with fewer than 3, stay whole."""
    by = list(by)
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), c(k).alias("v")) for k in ("x", "y")])).alias("_a")
    long = points.select(*by, both).select(*by, c("_a.axis").alias("_axis"), c("_a.v").alias("_v"))
    found = group_quantiles(long, [*by, "_axis"], "_v", {"lo": lo, "hi": hi}, METRIC, count="_n")
    on = lambda k, name: F.max(F.when(c("_axis") == k, c(name)))
    limits = found.groupBy(*by).agg(*[on(k, side).alias(f"_{k}{side}") for k in ("x", "y") for side in ("lo", "hi")], on("x", "_n").alias("_n"))
    inside = c("x").between(c("_xlo"), c("_xhi")) & c("y").between(c("_ylo"), c("_yhi"))
    whole = c("_n") < 20
    # A band that cuts at most a quarter of each axis leaves 3 of 20 points or more, whatever the points are.
    if lo + 1.0 - hi > 0.25:
        banded = salted_join(points.select(*by, "x", "y"), limits, by, "_n")
        limits = limits.join(banded.groupBy(*by).agg(F.count_if(inside).alias("_kept")), by)
        whole = whole | (c("_kept") < 3)
    limits = checkpointed(limits.withColumn("_whole", whole).drop("_kept"))
    rows = salted_join(points, limits, by, "_n")
    return rows.where(c("_whole") | inside).drop("_xlo", "_xhi", "_ylo", "_yhi", "_whole")


def bounds(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bounding box and centroid per group."""
    return points.groupBy(*by).agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"),
    )


_ANGLES = np.linspace(0.0, 2.0 * np.pi, 16, endpoint=False)
_DIRECTIONS = np.column_stack([np.cos(_ANGLES), np.sin(_ANGLES)])


def _outer_points(xy: np.ndarray) -> np.ndarray:
    """Drops points strictly inside the polygon of the extremes in 16 directions; none of them is a hull vertex."""
    corners = xy[(xy @ _DIRECTIONS.T).argmax(axis=0)]
    inside = np.ones(len(xy), dtype=bool)
    margin = 1e-9 * max(float(np.ptp(xy, axis=0).max()), 1e-300) ** 2
    for a, b in zip(corners, np.roll(corners, -1, axis=0)):
        edge = b - a
        if edge.any():
            inside &= edge[0] * (xy[:, 1] - a[1]) - edge[1] * (xy[:, 0] - a[0]) > margin
    return xy[~inside]


def hull_of(xy: np.ndarray) -> np.ndarray:
    """Convex hull vertices, counter-clockwise, without collinear points (fewer than three when degenerate)."""
    if len(xy) > 64:
        xy = _outer_points(xy)
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) >= 2:
                a, b = out[-2], out[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                out.pop()
            out.append(p)
        return out

    rows = xy.tolist()
    return np.array(chain(rows)[:-1] + chain(rows[::-1])[:-1])


BUFFER_ROWS = 1_000_000
#: Directions, none along an axis or a diagonal, in which the outermost point of a group is looked up.
_LOOKS = [(float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0.1, 0.1 + 2.0 * np.pi, 16, endpoint=False)]


def border_points(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points (by, x, y) that do not lie strictly inside the polygon of their group's outermost points in 16 directions.

    None of the others is a vertex of the hull. One aggregation finds the polygons, one join drops the inside, and hardly a point is left.
    """
    by = list(by)
    slim = points.select(*by, "x", "y")
    reach = [c("x") * dx + c("y") * dy for dx, dy in _LOOKS]
    outer = slim.groupBy(*by).agg(
        *[F.max_by(k, r).alias(f"_{k}{i}") for i, r in enumerate(reach) for k in ("x", "y")], *[F.max(r).alias(f"_r{i}") for i, r in enumerate(reach)],
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_size"), F.count(F.lit(1)).alias("_n"))
    outer = checkpointed(outer)
    # Where two points reach as far, x and y may come from either; such a corner counts only if it is as far out itself.
    sound = F.lit(True)
    for i, (dx, dy) in enumerate(_LOOKS):
        sound = sound & (F.abs(c(f"_x{i}") * dx + c(f"_y{i}") * dy - c(f"_r{i}")) <= 1e-12 * F.greatest(F.abs(f"_r{i}"), F.lit(1e-300)))
    outer = outer.withColumn("_sound", sound).drop(*[f"_r{i}" for i in range(len(_LOOKS))])
    placed = salted_join(slim, outer.withColumn("_rows", c("_n")), by, "_rows")
    inside, edges = c("_sound") & (c("_n") > 64), F.lit(False)
    for i in range(len(_LOOKS)):
        ax, ay, bx, by_ = c(f"_x{i}"), c(f"_y{i}"), c(f"_x{(i + 1) % len(_LOOKS)}"), c(f"_y{(i + 1) % len(_LOOKS)}")
        same = (ax == bx) & (ay == by_)
        left = (bx - ax) * (c("y") - ay) - (by_ - ay) * (c("x") - ax) > F.lit(1e-9) * c("_size") * c("_size")
        inside, edges = inside & (same | left), edges | ~same
    inside = inside & edges
    return placed.where(~F.coalesce(inside, F.lit(False))).select(*by, "x", "y")


def _group_hulls(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The rows of every group that are vertices of its hull; groups of up to three rows stay as they are."""
    rows = pdf.groupby(by, sort=False, dropna=False)["x"].transform("size").to_numpy()
    few, pdf = pdf[rows <= 3][[*by, "x", "y"]], pdf[rows > 3].reset_index(drop=True)
    if pdf.empty:
        return few
    xy = pdf[["x", "y"]].to_numpy()
    parts = []
    for key, rows in pdf.groupby(by, sort=False, dropna=False).indices.items():
        hull = hull_of(xy[rows])
        parts.append((key if isinstance(key, tuple) else (key,), hull))
    lengths = [len(hull) for _, hull in parts]
    out = {name: np.repeat(np.array([key[i] for key, _ in parts], dtype=object), lengths) for i, name in enumerate(by)}
    hulls = np.vstack([hull for _, hull in parts])
    found = pd.DataFrame({**out, "x": hulls[:, 0], "y": hulls[:, 1]})
    return found if few.empty else pd.concat([few, found], ignore_index=True)


def convex_hulls(points: DataFrame, by: Sequence[str] = ("plot",), partitions_per_part: int = 256) -> DataFrame:
    """``hull``: ordered vertices of each group's convex hull, null when degenerate.

    The hull of a union is the hull of the parts' hulls: every input partition keeps one hull per group, those of a
    block of partitions are merged next, and only then all of a group, so no group is collected whole.
    """
    by = list(by)
    keyed = border_points(points, by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields if f.name in by)

    def partition_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() // partitions_per_part
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= BUFFER_ROWS:  # reduce now and then, so that memory holds hulls and one buffer
                held = [_group_hulls(pd.concat(held), by)]
                rows = len(held[0]) // 2
        if held:
            yield _group_hulls(pd.concat(held), by).assign(_part=part)[[*by, "_part", "x", "y"]]

    def part_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = hull_of(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "x": hull[:, 0], "y": hull[:, 1]}, columns=[*by, "x", "y"])

    def whole_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = hull_of(pdf[["x", "y"]].to_numpy())
        corners = [{"x": float(x), "y": float(y)} for x, y in hull] if len(hull) >= 3 else None
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "hull": [corners]})

    partial = keyed.mapInPandas(partition_hulls, f"{schema}, `_part` int, x double, y double")
    partial = map_groups(partial, [*by, "_part"], part_hull, f"{schema}, x double, y double")
    return map_groups(partial, by, whole_hull, f"{schema}, hull array<struct<x:double,y:double>>")


def min_area_box(hull: np.ndarray) -> np.ndarray | None:
    """The four corners of the smallest rectangle around a hull; one of its sides lies on a hull edge."""
    edges = np.roll(hull, -1, axis=0) - hull
    lengths = np.hypot(edges[:, 0], edges[:, 1])
    units = edges[lengths > 0] / lengths[lengths > 0, None]
    if len(units) == 0:
        return None
    normals = np.column_stack([-units[:, 1], units[:, 0]])
    along, across = hull @ units.T, hull @ normals.T  # vertices x candidate directions
    area = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    best = int(np.argmin(area))
    a = (along[:, best].min(), along[:, best].max())
    b = (across[:, best].min(), across[:, best].max())
    corners = np.array([[a[0], b[0]], [a[1], b[0]], [a[1], b[1]], [a[0], b[1]]])
    return corners @ np.vstack([units[best], normals[best]])


def min_area_rectangles(hulls: DataFrame) -> DataFrame:
    """``corners`` of the smallest rectangle around each ``hull`` (null when the hull is)."""
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def box(hull: pd.Series) -> pd.Series:
        out = []
        for vertices in hull:
            if vertices is None or len(vertices) < 3:
                out.append(None)
                continue
            corners = min_area_box(np.array([[v["x"], v["y"]] for v in vertices]))
            out.append(None if corners is None else [{"x": float(x), "y": float(y)} for x, y in corners])
        return pd.Series(out)

    return hulls.withColumn("corners", box("hull"))


def footprints(points: DataFrame, by: Sequence[str] = ("plot",)) -> DataFrame:
    """Centroid of all points and rectangle of the trimmed points per plot."""
    centroid = points.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    boxes = min_area_rectangles(convex_hulls(trim_outliers(points, by), by)).select(*by, "corners")
    return centroid.join(boxes, list(by), "left")


# --------------------------------------------------------------------------------------- grids
def largest_spans(points: DataFrame, scale: float = 1.0, by: str = "filename") -> DataFrame:
    """One row: the largest x and y extent of any cloud, in output units."""
    spans = points.groupBy(by).agg((F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy"))
    return spans.agg(
        (F.coalesce(F.greatest(F.max("dx"), F.lit(0.0)), F.lit(0.0)) * scale).alias("span_x"),
        (F.coalesce(F.greatest(F.max("dy"), F.lit(0.0)), F.lit(0.0)) * scale).alias("span_y"),
    )


def grid_pitch(spans: DataFrame, padding: float = 0.10) -> DataFrame:
    factor = F.lit(1.0 + max(padding, 0.0))
    return spans.select(
        (F.greatest("span_x", F.lit(1e-9)) * factor).alias("pitch_x"), (F.greatest("span_y", F.lit(1e-9)) * factor).alias("pitch_y"),
    )


def grid_cells(entries: DataFrame, columns: int = 10) -> DataFrame:
    """Adds ``cell_col`` and ``cell_row``: the field's own grid when every entry has a row, else reading order."""
    if entries.where(c("row").isNull()).isEmpty():
        least = entries.agg(F.min("col").alias("c"), F.min("row").alias("r"))
        return (
            entries.withColumn("cell_col", (c("col") - least.select("c").scalar()).cast("bigint"))
            .withColumn("cell_row", (c("row") - least.select("r").scalar()).cast("bigint"))
        )
    columns = max(columns, 1)
    order = ["number"] + [n for n in ("file_no", "name") if n in entries.columns]
    ranked = ordered_rank(entries, order, "_i")
    return (
        ranked.withColumn("cell_col", ((c("_i") - 1) % columns).cast("bigint"))
        .withColumn("cell_row", F.floor((c("_i") - 1) / columns).cast("bigint")).drop("_i")
    )


def place_on_grid(points: DataFrame, cells: DataFrame, pitch: DataFrame, by: str = "filename") -> DataFrame:
    """Move each cloud's box midpoint to its cell; rows run downwards and z is untouched."""
    middle = points.groupBy(by).agg(
        ((F.min("x") + F.max("x")) / 2).alias("_mx"), ((F.min("y") + F.max("y")) / 2).alias("_my"), F.count(F.lit(1)).alias("_n"))
    shift = middle.join(cells.select(by, "cell_col", "cell_row"), by).select(
        by, "_n", (c("cell_col") * pitch.select("pitch_x").scalar() - c("_mx")).alias("_sx"),
        (-c("cell_row") * pitch.select("pitch_y").scalar() - c("_my")).alias("_sy"))
    moved = salted_join(points, shift, [by], "_n")
    return moved.withColumn("x", c("x") + c("_sx")).withColumn("y", c("y") + c("_sy")).drop("_sx", "_sy")


def auto_grid(plots: DataFrame) -> DataFrame:
    """One row: a square-ish grid that holds every distinct plot, numbered from the smallest."""
    distinct = plots.select("plot").distinct()
    counted = distinct.agg(F.count(F.lit(1)).alias("n"), F.min("plot").alias("base"))
    rows = F.greatest(F.lit(1), F.ceil(F.sqrt(c("n").cast("double")))).cast("bigint")
    return counted.withColumn("rows", rows).select(
        "n", "rows", F.greatest(F.lit(1), F.ceil(c("n") / c("rows"))).cast("bigint").alias("cols"), "base")


def field_layout(spark: SparkSession, rows: int, cols: int, base: int, start: str = "top-left", major: str = "row",
                 snake: bool = False) -> DataFrame:
    """plot -> (row, col) for consecutive numbers from ``base``; row 0 is the top."""
    if rows <= 0 or cols <= 0:
        return spark.createDataFrame([], "plot bigint, row bigint, col bigint")
    line_length = rows if major == "column" else cols
    cells = spark.range(rows * cols).select(
        (c("id") + base).alias("plot"), F.floor(c("id") / line_length).alias("line"), (c("id") % line_length).alias("step"))
    if snake:
        cells = cells.withColumn("step", F.when(c("line") % 2 == 1, line_length - 1 - c("step")).otherwise(c("step")))
    row, col = (c("step"), c("line")) if major == "column" else (c("line"), c("step"))
    row = row if "top" in start else F.lit(rows - 1) - row
    col = col if "left" in start else F.lit(cols - 1) - col
    return cells.select("plot", row.cast("bigint").alias("row"), col.cast("bigint").alias("col"))


def residuals(points: DataFrame, keys: Sequence[str] = ("filename",), height: str = "height") -> DataFrame:
    """Height of every point above its cloud's fitted plane and mean (statistics joined back to the points)."""
    from plotspark.operators.features import axis_columns, plane_columns

    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(height).alias("h_avg"), F.avg("x").alias("x_avg"), F.avg("y").alias("y_avg"),
        F.var_samp("x").alias("x_vs"), F.var_samp("y").alias("y_vs"), F.covar_samp("x", "y").alias("xy_cs"),
        F.covar_samp("x", height).alias("xh_cs"), F.covar_samp("y", height).alias("yh_cs"))
    plane = plane_columns(axis_columns(stats)).select(*keys, "_n", "h_avg", "x_avg", "y_avg", "plane_a", "plane_b")
    rows = salted_join(points, plane, list(keys), "_n")
    level = c("h_avg") + c("plane_a") * (c("x") - c("x_avg")) + c("plane_b") * (c("y") - c("y_avg"))
    return (
        rows.withColumn("plane_h", level).withColumn("residual", c(height) - level)
        .drop("h_avg", "x_avg", "y_avg", "plane_a", "plane_b")
    )


def remap_labels(masks: DataFrame, remap: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Move every attribute to the geometry of the partner label; originals stay as ``orig_*``.

    ``remap`` has (label, partner); a label without partner, or whose partner has no mask, keeps its own attributes.
    """
    own = masks.join(remap, "label", "left").withColumn("_want", F.coalesce("partner", "label")).drop("partner")
    source = masks.select(c("label").alias("_want"), F.struct(c("label"), *[n for n in attributes if n != "label"]).alias("_src"))
    joined = own.join(source, "_want", "left")
    names = ["label", *[n for n in attributes if n != "label"]]
    others = [n for n in masks.columns if n not in names]
    return joined.select(
        *[F.when(c("_src").isNotNull(), c(f"_src.{n}")).otherwise(c(n)).alias(n) for n in names],
        *[c(n).alias(f"orig_{n}") for n in names],
        (c("_src").isNotNull() & (c("_want") != c("label"))).alias("moved"), *others,
    )
