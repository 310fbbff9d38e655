"""Semantic settings and the column contracts of the shared tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Classification codes, bin width and stratum share of the reported feature definitions.
VEG_CODE = 1
GROUND_CODE = 2
ENTROPY_BIN = 0.1
STRATA_PCT = 5.0


@dataclass(frozen=True)
class FeatureConfig:
    """Which points and channels the features are computed from."""

    height: str = "height"
    veg_code: int = VEG_CODE
    ground_code: int = GROUND_CODE
    entropy_bin: float = ENTROPY_BIN
    red: str | None = "red"
    green: str | None = "green"
    blue: str | None = "blue"
    strata_pct: float = STRATA_PCT


POINT_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("point_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("intensity", T.IntegerType()),
    T.StructField("classification", T.IntegerType()),
    T.StructField("red", T.IntegerType()),
    T.StructField("green", T.IntegerType()),
    T.StructField("blue", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.DoubleType())),
])
