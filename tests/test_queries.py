"""The registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

CHECKED = ["a02_height_percentiles", "a07_height_entropy", "a14_axis_asymmetry", "a34_metric_cube", "j02_reference_lookup", "j05_match_report",
           "w04_random_systematic_folds", "w05_random_folds", "g01_augmentation_plan", "m03_ridge", "m04_lasso_four_features", "m07_boosted_round", "m16_permutation_importance", "a25_convex_hulls"]


def canonical(v):
    return ("nan" if math.isnan(v) else round(v, 7) + 0.0) if isinstance(v, float) else v


def test_every_query_has_a_plan_and_most_have_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 120 and len(sql) >= 105


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(canonical(r[names.index(k)]) for k in sorted(names)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(canonical(r[k]) for k in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and len(df.columns) > 30
