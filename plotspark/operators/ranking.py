"""Exact order statistics, ranks and fixed-size samples whose groups may be arbitrarily large.

A plain window puts a whole group into one task. Everything here works in levels instead: a histogram over
order-preserving buckets (map-side combined, at most a few thousand rows per group) finds *where* an order statistic
lies, and only the rows of those buckets are looked at again. Results are exact, and the plan is the same for inputs
of every size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotspark.functions.rng import hash_uniform
from plotspark.session import checkpointed

SHARES = 4096  # a joined group is cut so that no task gets more than about this fraction of all rows


def row_spread(df: DataFrame) -> Column:
    """A digest by which rows are dealt out: of the point's id where there is one, else of all columns that can be hashed."""
    if "point_id" in df.columns:
        return F.xxhash64("point_id")
    return F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, how: str = "inner",
                shares: int = SHARES) -> DataFrame:
    """Join per-group values onto rows when one group may hold a large share of the rows.

    ``small`` has ``weight``, the group's number of rows in ``big`` (the same in all of a group's rows). A group with more than 1/shares of
    all rows is cut: its rows draw a salt (``row_spread``) and its small row is repeated per salt. There can be at
    most ``shares`` such groups, so the list of them is safe to broadcast whatever the data. All other groups join
    as they are; when the whole small side is small, Spark broadcasts it and no row moves. ``weight`` is dropped.
    """
    keys = list(keys)
    total = small.agg(F.greatest(F.sum(weight), F.lit(1))).scalar()
    sized = small.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col(weight) * F.lit(shares) / total)).cast("int"))
    crowded = sized.where(F.col("_salts") > 1).select(*keys, "_salts").distinct()
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(F.broadcast(crowded), keys, "left").withColumn("_salt", F.pmod(row_spread(big), salts).cast("int"))
    right = sized.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.drop("_salts").join(right.drop("_salts", weight), [*keys, "_salt"], how).drop("_salt")


def attach(rows: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join small per-group values; without keys the single row of values becomes scalar columns."""
    if keys:
        return rows.join(values, list(keys))
    return rows.withColumns({n: values.select(n).scalar() for n in values.columns})


Buckets = tuple[Callable[[Column], Column], ...]

# Order-preserving buckets, coarse then fine: constant relative width for values of unknown scale ...
MAGNITUDE: Buckets = tuple(
    (lambda v, k=k: F.floor(F.signum(v) * F.log1p(F.abs(v) * 1000.0) * k).cast("bigint")) for k in (64.0, 64.0 * 65536.0))
# ... and a constant width (1.6 cm, then 0.24 um) for heights and coordinates in metres.
METRIC: Buckets = tuple((lambda v, k=k: F.floor(v * k).cast("bigint")) for k in (64.0, 64.0 * 65536.0))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float],
                    buckets: Buckets = MAGNITUDE, count: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group: columns ``keys + quantiles`` (and ``count`` of the values).

    ``quantiles`` maps an output name to a share in [0, 1]; nulls are ignored. Each level of ``buckets`` counts rows
    per bucket and keeps the buckets that hold a wanted rank; only their rows reach the next level. The buckets decide
    how work is shared between tasks, never the result.
    """
    named, keys = list(keys), list(keys) or ["_one"]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("_v"))
    if not named:
        rows = rows.withColumn("_one", F.lit(1))

    def wanted_here(n: Column, start: Column, stop: Column) -> Column:
        hit = F.lit(False)
        for q in quantiles.values():
            position = F.lit(float(q)) * (n - 1)
            for rank in (F.floor(position), F.ceil(position)):
                hit = hit | ((rank >= start) & (rank < stop))
        return hit

    group = list(keys)
    for level, bucket in enumerate(buckets):
        rows = rows.withColumn(f"_b{level}", bucket(F.col("_v")))
        carried = ["_start", "_n"] if level else []
        counts = rows.groupBy(*group, *carried, f"_b{level}").agg(F.count(F.lit(1)).alias("_c"))
        inside = Window.partitionBy(*group)
        before = F.sum("_c").over(inside.orderBy(f"_b{level}")) - F.col("_c")
        counts = counts.withColumn("_from", (F.col("_start") + before) if level else before)
        counts = counts.withColumn("_total", F.col("_n") if level else F.sum("_c").over(inside))
        group = [*group, f"_b{level}"]
        hit = counts.where(wanted_here(F.col("_total"), F.col("_from"), F.col("_from") + F.col("_c")))
        hit = hit.select(*group, F.col("_from").alias("_start"), F.col("_total").alias("_n"))
        rows = rows.drop(*carried).join(hit, group)

    values = rows.groupBy(*group, "_start", "_n", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*group).orderBy("_v")
    values = values.withColumn("_to", F.col("_start") + F.sum("_c").over(inside))
    values = values.withColumn("_from", F.col("_to") - F.col("_c"))

    picks = []
    for i, q in enumerate(quantiles.values()):
        position = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (rank >= F.col("_from")) & (rank < F.col("_to"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    found = values.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    outputs = []
    for i, (name, q) in enumerate(quantiles.items()):
        position = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    if count is not None:
        outputs.append(F.col("_n").alias(count))
    return found.select(*named, *outputs)


def hash_rank(df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], out: str = "rank",
              size_col: str | None = None) -> DataFrame:
    """1-based rank of every row by a hex digest within its group.

    Digests are uniform, so equal digest ranges split even a huge group into equal parts (the square root of
    ``size_col``, the group's size, when it is known); the rank is the number of rows in earlier parts plus the rank
    inside the part.
    """
    keys = list(keys)
    ranges = F.ceil(F.sqrt(F.col(size_col).cast("double"))) if size_col else F.lit(16384)
    part = [*keys, "_part"]
    rows = df.withColumn("_part", F.floor(hash_uniform(F.col(digest)) * ranges))
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    offsets = counts.withColumn("_before", F.sum("_c").over(order.orderBy("_part")) - F.col("_c")).drop("_c")
    local = F.row_number().over(Window.partitionBy(*part).orderBy(digest, *ties))
    return (
        rows.withColumn("_local", local).join(offsets, part)
        .withColumn(out, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local")
    )


def hash_sample(df: DataFrame, keys: Sequence[str], digest: str, ties: Sequence[str], quota: DataFrame,
                quota_col: str, size_col: str | None = None, keep_rest: bool = False) -> DataFrame:
    """Exactly ``quota`` rows per group: those with the smallest digests (ties in order of ``ties``).

    Digests are uniform. A histogram of equal digest ranges finds the range in which the quota runs out, and ranking
    the rows of that range alone finds the last digest that is kept; the rows themselves are only filtered. With
    ``size_col``, the number of rows of the row's group, a group is cut into the square root of its size. Groups
    without a quota are dropped, or kept whole with ``keep_rest``.
    """
    keys = list(keys)
    ranges = F.ceil(F.sqrt(F.col(size_col).cast("double"))) if size_col else F.lit(4096)
    slim = df.select(*keys, digest, *ties, ranges.alias("_ranges"))
    limits = quota.select(*keys, F.col(quota_col).alias("_quota"))
    whole = Window.partitionBy(*keys)
    slim = slim.withColumn("_part", F.floor(hash_uniform(F.col(digest)) * F.col("_ranges")))
    counts = slim.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(whole.orderBy("_part"))).withColumn("_rows", F.sum("_c").over(whole))
    before = F.col("_upto") - F.col("_c")
    border = counts.join(limits, keys).withColumn("_quota", F.least("_quota", "_rows"))
    border = border.where((F.col("_upto") >= F.col("_quota")) & (before < F.col("_quota")))
    edge = slim.join(border.select(*keys, "_part", "_rows", (F.col("_quota") - before).alias("_need")), [*keys, "_part"])
    last = F.struct(F.col(digest).alias("d"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)])
    edge = edge.withColumn("_rank", F.row_number().over(whole.orderBy(digest, *ties))).where(F.col("_rank") <= F.col("_need"))
    cut = edge.groupBy(*keys).agg(F.max(last).alias("_cut"), F.max("_rows").alias("_rows"))
    marked = salted_join(df, cut, keys, "_rows", "left" if keep_rest else "inner")
    kept = last <= F.col("_cut")
    if keep_rest:
        kept = F.col("_cut").isNull() | kept
    return marked.where(kept).drop("_cut")


def ordered_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """1-based rank of every row in a total order over the whole table.

    Range-partitioned sort, then per-partition counts: no task sees more than its range. The sorted rows are
    checkpointed so that counting and numbering read the same partitions.
    """
    position = F.monotonically_increasing_id()  # partition number in the high bits, row index in the low 33
    ranked = checkpointed(df.orderBy(*order).withColumn("_pos", position))
    ranked = ranked.withColumn("_range", F.shiftright("_pos", 33))
    counts = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")
    offsets = counts.select("_range", before.alias("_before"))  # one row per sort partition
    local = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranked.join(F.broadcast(offsets), "_range")
        .withColumn(out, F.col("_before") + local + 1).drop("_pos", "_range", "_before")
    )


def count_below(df: DataFrame, keys: Sequence[str], value: str, out: str = "below", total: str = "total",
                buckets: Buckets = MAGNITUDE) -> DataFrame:
    """Per row: how many non-null values of its group are strictly smaller, and how many there are.

    Distinct values are counted first, then ranked inside coarse and inside fine buckets, so neither ties nor group size matter.
    """
    keys = list(keys)
    rows = df.withColumn("_k", F.lit(1)) if not keys else df
    group = keys or ["_k"]
    number = F.col(value).cast("double")
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_b0", buckets[0](number)).withColumn("_b1", buckets[1](number))

    def earlier(count: str, within: list[str], order: str) -> Column:
        return F.sum(count).over(Window.partitionBy(*within).orderBy(order)) - F.col(count)

    fine = counted.groupBy(*group, "_b0", "_b1").agg(F.sum("_c").alias("_n1"))
    coarse = fine.groupBy(*group, "_b0").agg(F.sum("_n1").alias("_n0"))
    coarse = coarse.withColumn("_before0", earlier("_n0", group, "_b0")).withColumn(total, F.sum("_n0").over(Window.partitionBy(*group)))
    fine = fine.withColumn("_before1", earlier("_n1", [*group, "_b0"], "_b1")).join(coarse.drop("_n0"), [*group, "_b0"])
    placed = counted.withColumn("_inside", earlier("_c", [*group, "_b0", "_b1"], value)).join(fine.drop("_n1"), [*group, "_b0", "_b1"])
    ranks = placed.select(*group, value, (F.col("_before0") + F.col("_before1") + F.col("_inside")).alias(out), total)
    # Nothing after this join needs a value's rows together, so Spark may split the rows of a frequent one between tasks.
    return rows.join(ranks, [*group, value], "left").select(*df.columns, out, total)
