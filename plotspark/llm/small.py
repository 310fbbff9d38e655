"""Small tables that were looked at before they are broadcast, and tables written so that Spark knows their true size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotspark.session import checkpointed, scratch_path

BROADCAST_ROWS = 50_000


def settled(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` worked out once, and marked for broadcast if it has no more than ``most_rows`` rows; beyond that joins shuffle as usual."""
    done = checkpointed(df)
    return F.broadcast(done) if done.count() <= most_rows else done


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    A checkpoint keeps the size that was estimated for it, and estimates multiply in joins: where each round joins the last one's result with
    itself they soon have more digits than can be worked with. A file has a size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
