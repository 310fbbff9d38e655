"""Random numbers as pure functions of a key.

Every draw is a function of md5(seed:...:row id), so it does not depend on partitioning, retries or the number of
executors: a recomputed task after an executor loss gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = float(2 ** 52)


def key_hash(*parts) -> Column:
    """32 hex digits of the parts joined by ':'."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hash_uniform(digest: Column, half: int = 0) -> Column:
    """A uniform in [0, 1) from 13 hex digits; the two halves of a digest give two independent draws."""
    return F.conv(F.substring(digest, 1 + 16 * half, 13), 16, 10).cast("double") / F.lit(_SCALE)


def uniform(*parts) -> Column:
    return hash_uniform(key_hash(*parts))


def uniform_between(lo: float, hi: float, *parts) -> Column:
    return F.lit(float(lo)) + uniform(*parts) * F.lit(float(hi) - float(lo))


def with_normals(df: DataFrame, first: str, second: str, wanted: Column, *parts) -> DataFrame:
    """Adds two independent standard normals (Box-Muller) from one digest, null where not ``wanted``.

    Digest, radius and angle are columns of their own, so each is computed once per row.
    """
    df = df.withColumn("_digest", F.when(wanted, key_hash(*parts)))
    df = df.withColumn("_radius", F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_uniform(F.col("_digest"), 0))))
    df = df.withColumn("_angle", F.lit(2.0 * math.pi) * hash_uniform(F.col("_digest"), 1))
    radius, angle = F.col("_radius"), F.col("_angle")
    return df.withColumns({first: radius * F.cos(angle), second: radius * F.sin(angle)}).drop("_digest", "_radius", "_angle")


def inner_seed(seed: int, cycle: Column) -> Column:
    """An independent 31-bit seed per outer cycle."""
    return F.conv(F.substring(key_hash(seed, "cycle", cycle), 1, 7), 16, 10).cast("bigint")
