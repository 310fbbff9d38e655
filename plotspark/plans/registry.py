"""The queries the driver runs: name -> Spark plan and, where SQL can express it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists")
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def rounded(value: Column | str, digits: int = 6) -> Column:
    """A computed double as compared with the checker (and never -0.0)."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def rounded_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        rounded(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])
