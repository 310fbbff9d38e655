"""Plot identities of whole tables: import plans, packing, duplicates and keyed reference sheets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotspark.functions import naming

c = F.col


def stride_of(widest: Column) -> Column:
    """The smallest power of ten, at least 10, above every column number."""
    digits = F.length(F.greatest(widest, F.lit(0)).cast("string"))
    return F.coalesce(F.greatest(F.lit(10), F.pow(F.lit(10), digits)).cast("bigint"), F.lit(10).cast("bigint"))


def key_stride(keys: DataFrame, col: str = "col") -> DataFrame:
    """One row with ``stride`` for all keys of a table."""
    return keys.agg(stride_of(F.max(col)).alias("stride"))


def read_keys(df: DataFrame, text: Column, fmt: naming.KeyFormat) -> DataFrame:
    """Adds ``col`` and ``row`` read from ``text`` (null ``col``: not readable)."""
    key = naming.plot_key(text, fmt)
    return df.withColumn("_key", key).withColumn("col", c("_key.col")).withColumn("row", c("_key.row")).drop("_key")


@dataclass(frozen=True)
class ImportPlan:
    """``entries`` carry col, row and number; ``unreadable`` names no column; ``duplicates`` share a number."""

    entries: DataFrame
    unreadable: DataFrame
    stride: DataFrame

    @property
    def duplicates(self) -> DataFrame:
        """Every entry whose number is claimed more than once, with the number of claims."""
        claims = self.entries.groupBy("number").agg(F.count(F.lit(1)).alias("claims")).where(c("claims") > 1)
        return self.entries.join(claims, "number")

    @property
    def is_clean(self) -> DataFrame:
        """One row: is every identity distinct and readable?"""
        counts = self.entries.agg(
            F.count(F.lit(1)).alias("entries"), F.count_distinct("number").alias("numbers")
        )
        unreadable = self.unreadable.agg(F.count(F.lit(1)).alias("n")).scalar()
        return counts.select(
            "entries", "numbers", unreadable.alias("unreadable"),
            ((c("entries") == c("numbers")) & (unreadable == 0)).alias("is_clean"),
        )


def plan_import(files: DataFrame, name: str, fmt: naming.KeyFormat) -> ImportPlan:
    """Numbers derived from the file names alone, so that every import of the same files agrees.

    Names are read once: the stride, the entries and their claims all need the keys.
    """
    keyed = read_keys(files, naming.stem(c(name)), fmt).persist(StorageLevel.MEMORY_AND_DISK)
    entries = keyed.where(c("col").isNotNull())
    stride = key_stride(entries)
    number = naming.packed_key(c("col").cast("bigint"), c("row").cast("bigint"), stride.scalar())
    return ImportPlan(entries.withColumn("number", number), keyed.where(c("col").isNull()).drop("col", "row"), stride)


def surviving_files(entries: DataFrame, order: str) -> DataFrame:
    """One file per number: the later file wins, as when files are written over each other."""
    others = [n for n in entries.columns if n != "number"]
    last = entries.groupBy("number").agg(F.max_by(F.struct(*others), order).alias("_f"))
    return last.select("number", "_f.*")


@dataclass(frozen=True)
class ReferenceSheet:
    """A sheet keyed by ``plot`` with its data columns; ``row_no`` orders rows of equal key."""

    frame: DataFrame
    columns: tuple[str, ...]
    key_column: str
    order: str = "row_no"

    @property
    def duplicate_keys(self) -> DataFrame:
        counts = self.frame.groupBy("plot").agg(F.count(F.lit(1)).alias("rows"))
        return counts.where(c("rows") > 1)


def key_sheet(sheet: DataFrame, key_column: str | None = None, fmt: naming.LabelFormat | None = None, row_column: str | None = None,
              stride: int | DataFrame | None = None, order: str = "row_no") -> ReferenceSheet:
    """Key a sheet by plot number.

    A missing key column means the first one. With a row column the pair is packed by the import's own rule and the
    row column is dropped; rows whose key cannot be read are dropped.
    """
    data = [n for n in sheet.columns if n != order]
    key = key_column if key_column in data else data[0]
    use_row = row_column is not None and row_column in data and row_column != key
    keyed = sheet.withColumn("_col", naming.label_number(c(key), fmt).cast("bigint"))
    keyed = keyed.withColumn("_row", naming.label_number(c(row_column), fmt).cast("bigint") if use_row else F.lit(None).cast("bigint"))
    keyed = keyed.where(c("_col").isNotNull() & (c("_row").isNotNull() if use_row else F.lit(True)))
    if not use_row:
        plot = c("_col")
    else:
        if stride is None:
            stride = key_stride(keyed, "_col")
        packing = stride.scalar() if isinstance(stride, DataFrame) else F.lit(stride).cast("bigint")
        plot = naming.packed_key(c("_col"), c("_row"), packing)
    columns = tuple(n for n in data if n != key and not (use_row and n == row_column))
    frame = keyed.select(plot.alias("plot"), *columns, order)
    return ReferenceSheet(frame, columns, key, order)
