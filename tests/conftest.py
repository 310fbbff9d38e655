import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plotspark.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "plotspark-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


@pytest.fixture
def cloud(spark):
    """cloud(rows, **defaults): a points table from dicts."""
    fields = "filename string, point_id bigint, x double, y double, z double, height double, classification int, red int, green int, blue int"

    def build(rows, filename="plot(1).laz"):
        filled = []
        for i, row in enumerate(rows):
            full = {"filename": filename, "point_id": i, "x": 0.0, "y": 0.0, "z": 0.0, "height": 0.0, "classification": 1, "red": None, "green": None, "blue": None}
            full.update(row)
            full.update({k: float(full[k]) for k in ("x", "y", "z", "height") if full[k] is not None})
            filled.append(tuple(full[n.split()[0]] for n in fields.split(", ")))
        return spark.createDataFrame(filled, fields).coalesce(2)

    return build
