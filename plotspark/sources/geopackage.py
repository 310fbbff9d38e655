"""Optional reader for plot polygons in GeoPackage files (one small SQLite file per layer)."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.sources.masks import RINGS

# Bytes of the envelope that may precede the geometry, by flag.
ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def polygon_rings(blob: bytes | None) -> list[list[dict]] | None:
    """Rings of a (multi)polygon blob; null for a missing or empty geometry."""
    if not blob or blob[:2] != b"GP":
        return None
    flags = blob[3]
    at = 8 + ENVELOPE_BYTES[(flags >> 1) & 7]

    def shape(at: int) -> tuple[list[list[dict]], int]:
        order = "<" if blob[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", blob, at + 1)[0]
        at += 5
        dims = 2 + (1 if kind // 1000 in (1, 2) else 2 if kind // 1000 == 3 else 0)
        parts = struct.unpack_from(order + "I", blob, at)[0]
        at += 4
        rings: list[list[dict]] = []
        if kind % 1000 == 6:
            for _ in range(parts):
                inner, at = shape(at)
                rings += inner
        elif kind % 1000 == 3:
            for _ in range(parts):
                n = struct.unpack_from(order + "I", blob, at)[0]
                flat = struct.unpack_from(order + f"{n * dims}d", blob, at + 4)
                rings.append([{"x": flat[i * dims], "y": flat[i * dims + 1]} for i in range(n)])
                at += 4 + 8 * n * dims
        else:
            raise ValueError("only polygons can be plot masks")
        return rings, at

    rings, _ = shape(at)
    return rings or None


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """``properties`` and ``rings`` of every feature of the .gpkg files below ``path``; one task per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.where(F.lower("path").endswith(".gpkg")).repartition("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                local = uri[5:] if uri.startswith("file:") else uri
                con = sqlite3.connect(f"file:{'/' + local.lstrip('/')}?mode=ro", uri=True)
                try:
                    for layer, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
                        cursor = con.execute(f'SELECT * FROM "{layer}"')
                        names = [d[0] for d in cursor.description]
                        while rows := cursor.fetchmany(1000):
                            records = [dict(zip(names, r)) for r in rows]
                            yield pd.DataFrame({
                                "properties": [{k: None if v is None else str(v) for k, v in r.items() if k != column} for r in records],
                                "rings": [polygon_rings(r[column]) for r in records]})
                finally:
                    con.close()

    return files.mapInPandas(run, f"properties map<string,string>, rings {RINGS}")
