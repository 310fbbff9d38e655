"""Registered queries, grouped by the part of the engine they exercise."""

from __future__ import annotations

import importlib

MODULES = ("feature_queries", "naming_queries", "result_queries", "spatial_queries", "augment_queries", "model_queries", "table_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"plotspark.plans.{name}")


def all_queries():
    from plotspark.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from plotspark.plans.registry import SQL

    _load()
    return dict(SQL)
