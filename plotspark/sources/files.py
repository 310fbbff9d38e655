"""Reading big binary files in byte ranges: listing, splitting and failures as rows.

A cloud file may be far larger than one task should read, so files are listed by Spark, cut into ranges and read by
many tasks. A first pass over the ranges checks them and counts their rows (from headers alone where records have a
fixed size); a file with any failing range becomes a failure row and is left out, and never stops the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotspark.operators.groups import together

c = F.col

SPLIT_BYTES = 64 * 1024 * 1024
HEADER_BYTES = 64 * 1024


class RangeFile:
    """Random access to one file through the file system its path names."""

    def __init__(self, path: str):
        if "://" in path or path.startswith("file:"):
            fs, inner = pafs.FileSystem.from_uri(path)
        else:
            fs, inner = pafs.LocalFileSystem(), path
        self._handle = fs.open_input_file(inner)
        self.size = self._handle.size()

    def read(self, offset: int, length: int) -> bytes:
        return self._handle.read_at(max(0, min(length, self.size - offset)), offset) if offset < self.size else b""

    def __enter__(self) -> "RangeFile":
        return self

    def __exit__(self, *exc) -> None:
        self._handle.close()


def file_splits(spark: SparkSession, path: str, suffix: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, split, start, stop): byte ranges of every file below ``path`` with that suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.lower("path").endswith(suffix))
    last = F.greatest(F.lit(0), F.ceil(c("length") / F.lit(split_bytes)) - 1)
    splits = files.withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    return splits.select(
        "path", "split", (c("split") * split_bytes).alias("start"), F.least(c("length"), (c("split") + 1) * split_bytes).alias("stop"))


def scan(splits: DataFrame, count: Callable[[str, int, int], int], read: Callable[[str, int, int, int], Iterator[pd.DataFrame]],
         columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of all ranges.

    ``count(path, start, stop)`` checks a range and counts its rows; ``read(path, start, stop, before)`` gives frames
    of its rows, knowing how many rows of the file come before the range.
    """
    names = [part.split()[0] for part in columns.split(", ")]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, reasons = [], []
            for r in pdf.itertuples(index=False):
                try:
                    rows.append(count(r.path, int(r.start), int(r.stop)))
                    reasons.append(None)
                except Exception as exc:  # noqa: BLE001 - the reason is data
                    rows.append(0)
                    reasons.append(str(exc) or type(exc).__name__)
            yield pdf.assign(rows=rows, reason=reasons)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = (r for pdf in batches for r in pdf.itertuples(index=False))
        yield from together(frame.assign(path=r.path)[["path", *names]] for r in ranges for frame in read(r.path, int(r.start), int(r.stop), int(r.before)))

    checked = splits.repartition("path", "split").mapInPandas(check, "path string, split bigint, start bigint, stop bigint, rows bigint, reason string")
    checked = checked.persist(StorageLevel.MEMORY_AND_DISK)  # one row per range
    failures = checked.where(c("reason").isNotNull()).groupBy("path").agg(F.min("reason").alias("reason"))
    # A file larger than this window could hold in one task would need billions of ranges.
    before = F.sum("rows").over(Window.partitionBy("path").orderBy("split")) - c("rows")
    good = checked.join(failures.select("path"), "path", "left_anti").withColumn("before", before).where(c("rows") > 0)
    rows = good.select("path", "split", "start", "stop", "before").repartition("path", "split").mapInPandas(load, f"path string, {columns}")
    return rows, failures
