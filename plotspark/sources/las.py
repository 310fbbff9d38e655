"""Point clouds in uncompressed LAS files (1.2 to 1.4, formats 0-3 and 6-8), read in byte ranges."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.operators.groups import map_groups
from plotspark.operators.ranking import row_spread, salted_join
from plotspark.sources.files import SPLIT_BYTES, RangeFile, file_splits, scan

c = F.col

# Record lengths, byte positions of class and colour, extra-dimension types.
FORMATS = {0: (20, 15, None), 1: (28, 15, None), 2: (26, 15, 20), 3: (34, 15, 28), 6: (30, 16, None), 7: (36, 16, 30), 8: (38, 16, 30)}
EXTRA_TYPES = {1: "<u1", 2: "<i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}

COLUMNS = "point_id bigint, x double, y double, z double, intensity int, classification int, red int, green int, blue int, extra map<string,double>"
NAMES = ["point_id", "x", "y", "z", "intensity", "classification", "red", "green", "blue", "extra"]
BATCH = 50_000


class LasHeader:
    """Layout of one file: scales, offsets, record format and extra dimensions."""

    def __init__(self, file: RangeFile):
        raw = file.read(0, 375)
        if raw[:4] != b"LASF" or len(raw) < 227:
            raise ValueError("not a LAS file")
        minor = raw[25]
        header_size, self.body, vlrs = struct.unpack_from("<HII", raw, 94)
        self.format, self.length, legacy = struct.unpack_from("<BHI", raw, 104)
        if self.format & 0xC0:
            raise ValueError("compressed LAS records are not supported")
        if self.format not in FORMATS:
            raise ValueError(f"point format {self.format} is not supported")
        self.count = struct.unpack_from("<Q", raw, 247)[0] if minor >= 4 and len(raw) >= 255 else legacy
        self.scale = struct.unpack_from("<3d", raw, 131)
        self.offset = struct.unpack_from("<3d", raw, 155)
        self.extra = self._extra(file, header_size, vlrs)
        self.dtype = self._record()

    def _extra(self, file: RangeFile, at: int, vlrs: int) -> list[tuple[str, str, float, float]]:
        """(name, type, scale, offset) of the dimensions described in the header."""
        out = []
        for _ in range(vlrs):
            head = file.read(at, 54)
            if len(head) < 54:
                break
            user, record, length = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
            if user == b"LASF_Spec" and record == 4:
                body = file.read(at + 54, length)
                for i in range(0, length - 191, 192):
                    kind, options = body[i + 2], body[i + 3]
                    name = body[i + 4:i + 36].split(b"\0")[0].decode("ascii", "replace")
                    scale = struct.unpack_from("<d", body, i + 112)[0] if options & 8 else 1.0
                    offset = struct.unpack_from("<d", body, i + 136)[0] if options & 16 else 0.0
                    out.append((name, EXTRA_TYPES.get(kind, f"V{max(options, 1)}"), scale, offset))
            at += 54 + length
        return out

    def _record(self) -> np.dtype:
        size, label, colour = FORMATS[self.format]
        names, kinds, places = ["X", "Y", "Z", "intensity", "classification"], ["<i4", "<i4", "<i4", "<u2", "<u1"], [0, 4, 8, 12, label]
        if colour is not None:
            names, kinds, places = names + ["red", "green", "blue"], kinds + ["<u2"] * 3, places + [colour, colour + 2, colour + 4]
        for i, (_, kind, _, _) in enumerate(self.extra):
            names, kinds, places = names + [f"extra{i}"], kinds + [kind], places + [size]
            size += np.dtype(kind).itemsize
        if size > self.length:
            raise ValueError("extra dimensions exceed the record length")
        return np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": self.length})

    def frame(self, points: np.ndarray, first: int) -> pd.DataFrame:
        n = len(points)
        out = {"point_id": np.arange(first, first + n)}
        for i, (axis, raw) in enumerate(zip("xyz", "XYZ")):
            out[axis] = points[raw] * self.scale[i] + self.offset[i]
        out["intensity"] = points["intensity"].astype(np.int32)
        label = points["classification"].astype(np.int32)
        out["classification"] = label & 31 if self.format < 6 else label
        for k in ("red", "green", "blue"):
            out[k] = points[k].astype(np.int32) if k in self.dtype.names else None
        dims = [(name, points[f"extra{i}"] * scale + offset) for i, (name, kind, scale, offset) in enumerate(self.extra) if not kind.startswith("V")]
        names = [name for name, _ in dims]
        out["extra"] = [dict(zip(names, map(float, row))) for row in zip(*(v for _, v in dims))] if dims else [None] * n
        return pd.DataFrame(out)[NAMES]


def _records(file: RangeFile, head: LasHeader, start: int, stop: int) -> tuple[int, int]:
    """Numbers [first, last) of the records that begin inside a range; a truncated file is an error."""
    if max(0, file.size - head.body) // head.length < head.count:
        raise ValueError(f"truncated: fewer records than the {head.count} declared")
    at = lambda byte: min(head.count, max(0, -(-(byte - head.body) // head.length)))
    return at(start), at(stop)


def _count(path: str, start: int, stop: int) -> int:
    with RangeFile(path) as file:
        first, last = _records(file, LasHeader(file), start, stop)
        return last - first


def _read(path: str, start: int, stop: int, before: int) -> Iterator[pd.DataFrame]:
    with RangeFile(path) as file:
        head = LasHeader(file)
        first, last = _records(file, head, start, stop)
        for at in range(first, last, BATCH):
            raw = file.read(head.body + at * head.length, min(BATCH, last - at) * head.length)
            yield head.frame(np.frombuffer(raw, dtype=head.dtype), at)


def read_las(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(points, failures) of every .las file below ``path``; extra dimensions by name in ``extra``."""
    rows, failures = scan(file_splits(spark, path, ".las", split_bytes), _count, _read, COLUMNS)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", *NAMES), failures


def header_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, points) from the headers alone; 0 for a file that cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.where(F.lower("path").endswith(".las"))

    @F.pandas_udf("bigint")
    def count(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            try:
                with RangeFile(p) as file:
                    out.append(LasHeader(file).count)
            except Exception:  # noqa: BLE001 - unreadable counts as empty
                out.append(0)
        return pd.Series(out)

    return files.select("path", count("path").alias("points"))


LAS_NAME_BYTES = 32  # fixed value
LAS_SCALE = 0.0001  # fixed value: written resolution in metres


def _file_bytes(pdf: pd.DataFrame, dims: list[str], colour: bool) -> bytes:
    """One LAS 1.2 file of these points; the offset is their own corner, so any survey position fits."""
    extra = b""
    for name in dims:
        entry = bytearray(192)
        entry[2] = 10  # double
        entry[4:4 + len(name)] = name.encode("ascii")
        extra += bytes(entry)
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(extra), b"") + extra if dims else b""
    layout = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("rest", "V4" if not colour else "V12")]
    layout += [(k, "<u2") for k in ("red", "green", "blue")] if colour else []
    record = np.zeros(len(pdf), dtype=layout + [(f"extra{i}", "<f8") for i in range(len(dims))])
    corner = [float(pdf[a].min()) for a in "xyz"]
    for a, raw, low in zip("xyz", "XYZ", corner):
        record[raw] = np.rint((pdf[a].to_numpy() - low) / LAS_SCALE)
    for name in ("intensity", "classification") + (("red", "green", "blue") if colour else ()):
        if name in pdf:
            record[name] = pdf[name].fillna(0).to_numpy()
    for i, name in enumerate(dims):
        record[f"extra{i}"] = pdf[name].to_numpy()
    head = bytearray(227)
    head[0:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227 + len(vlr), 1 if dims else 0)
    struct.pack_into("<BHI", head, 104, 3 if colour else 0, record.dtype.itemsize, len(pdf))
    struct.pack_into("<3d", head, 131, *[LAS_SCALE] * 3)
    struct.pack_into("<3d", head, 155, *corner)
    high = [low + float(record[raw].max()) * LAS_SCALE for raw, low in zip("XYZ", corner)]
    struct.pack_into("<6d", head, 179, high[0], corner[0], high[1], corner[1], high[2], corner[2])
    return bytes(head) + vlr + record.tobytes()


def write_las(points: DataFrame, path: str, dims: list[str] | None = None, max_points: int = 500_000) -> DataFrame:
    """LAS files below ``path``, one per cloud and at most about ``max_points`` points each; returns what was written.

    A crowded cloud becomes several files (name.0.las, name.1.las, ...). A repeated task writes the same file again.
    """
    dims = list(dims or [])
    if bad := [d for d in dims if len(d.encode()) > LAS_NAME_BYTES or not d.isascii()]:
        raise ValueError(f"LAS stores dimension names of at most {LAS_NAME_BYTES} ASCII characters: {bad}")
    if "://" not in path and not path.startswith("file:") and not points.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster the folder needs its file system in front (hdfs://, s3://, file:// of a shared mount)")
    colour = {"red", "green", "blue"} <= set(points.columns)
    size = F.count(F.lit(1))
    parts = points.groupBy("filename").agg(F.ceil(size / F.lit(max_points)).alias("_parts"), size.alias("_n"))
    rows = salted_join(points, parts, ["filename"], "_n")
    rows = rows.withColumn("part", F.pmod(F.hash(row_spread(points)), c("_parts"))).drop("_parts")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name, part = pdf["filename"].iloc[0], int(pdf["part"].iloc[0])
        target = f"{path}/{name.rsplit('.', 1)[0]}.{part}.las"
        fs, inner = pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(_file_bytes(pdf, dims, colour))
        return pd.DataFrame({"filename": [name], "path": [target], "points": [len(pdf)]})

    written = map_groups(rows, ["filename", "part"], write, "filename string, path string, points bigint")
    written.write.mode("overwrite").parquet(f"{path}/_written")
    return points.sparkSession.read.parquet(f"{path}/_written")
