"""Point clouds in PCD files (ascii and binary), read in byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotspark.operators.ranking import row_spread, salted_join
from plotspark.sources.files import HEADER_BYTES, SPLIT_BYTES, RangeFile, file_splits, scan

c = F.col

# Element types, field aliases, class of unclassified points, 8 to 16 bit colour gain.
KINDS = {"F": {4: "<f4", 8: "<f8"}, "U": {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}, "I": {1: "<i1", 2: "<i2", 4: "<i4", 8: "<i8"}}
ALIASES = {"red": ("r", "red"), "green": ("g", "green"), "blue": ("b", "blue"), "classification": ("label", "classification", "class")}
DEFAULT_CLASS = 1
COLOUR_GAIN = 257

COLUMNS = "point_id bigint, x double, y double, z double, intensity int, classification int, red int, green int, blue int"
NAMES = [part.split()[0] for part in COLUMNS.split(", ")]
BATCH = 50_000


class PcdHeader:
    """The fields, encoding and extent of one file."""

    def __init__(self, raw: bytes):
        values: dict[str, list[str]] = {}
        position = 0
        while "DATA" not in values:
            stop = raw.find(b"\n", position)
            if stop < 0:
                raise ValueError("header without a DATA line")
            words = raw[position:stop].decode("ascii", "replace").split()
            position = stop + 1
            if words and not words[0].startswith("#"):
                values[words[0].upper()] = words[1:]
        self.body = position
        self.encoding = (values["DATA"] or ["ascii"])[0].lower()
        if self.encoding not in ("ascii", "binary"):
            raise ValueError(f"encoding {self.encoding!r} is not supported (only ascii and binary)")
        self.dtype = self._layout(values)
        self.declared = self._count(values)

    @staticmethod
    def _layout(values: dict[str, list[str]]) -> np.dtype:
        fields, sizes, types = (values.get(k) or [] for k in ("FIELDS", "SIZE", "TYPE"))
        if not fields or len(fields) != len(sizes) or len(fields) != len(types):
            raise ValueError("FIELDS, SIZE and TYPE are missing or differ in length")
        counts = values.get("COUNT") or ["1"] * len(fields)
        spec, used = [], set()
        for i, (field, size, kind, count) in enumerate(zip(fields, sizes, types, counts)):
            code = KINDS.get(kind.upper(), {}).get(int(size) if size.isdigit() else -1)
            if code is None:
                raise ValueError(f"unsupported field type {kind}{size} for {field!r}")
            name = field if field not in used else f"{field}#{i}"  # padding fields may repeat
            used.add(name)
            spec.append((name, code, (max(int(count), 1),)))
        return np.dtype(spec)

    @staticmethod
    def _count(values: dict[str, list[str]]) -> int | None:
        for parts in (values.get("POINTS", [])[:1], values.get("WIDTH", [])[:1] + values.get("HEIGHT", [])[:1]):
            if parts and all(p.lstrip("-").isdigit() for p in parts):
                return int(np.prod([int(p) for p in parts]))
        return None

    def field(self, *wanted: str) -> str | None:
        return next((n for n in self.dtype.names if n.lower() in wanted), None)

    def frame(self, points: np.ndarray, first: int) -> pd.DataFrame:
        """Points in the common columns; colour only when all three channels are there."""
        axes = [self.field(a) for a in ("x", "y", "z")]
        if None in axes:
            raise ValueError(f"x/y/z are not among the fields {list(self.dtype.names)}")
        n = len(points)
        whole = lambda name, top: np.clip(np.rint(points[name][:, 0].astype(np.float64)), 0, top).astype(np.int32)
        out = {"point_id": np.arange(first, first + n)}
        out.update({a: points[name][:, 0].astype(np.float64) for a, name in zip("xyz", axes)})
        intensity, label = self.field("intensity"), self.field(*ALIASES["classification"])
        out["intensity"] = whole(intensity, 65535) if intensity else None
        out["classification"] = whole(label, 255) if label else np.full(n, DEFAULT_CLASS, dtype=np.int32)
        colours = {k: self.field(*ALIASES[k]) for k in ("red", "green", "blue")}
        for k, name in colours.items():
            out[k] = whole(name, 255) * COLOUR_GAIN if None not in colours.values() else None
        return pd.DataFrame(out)[NAMES]


def _header(file: RangeFile) -> PcdHeader:
    return PcdHeader(file.read(0, HEADER_BYTES))


def _records(file: RangeFile, head: PcdHeader, start: int, stop: int) -> tuple[int, int]:
    """Numbers [first, last) of the binary records that begin inside a range; a truncated file is an error."""
    width = head.dtype.itemsize
    present = max(0, file.size - head.body) // width
    if head.declared is not None and present < head.declared:
        raise ValueError(f"truncated: {present} of {head.declared} declared points are there")
    total = present if head.declared is None else head.declared
    if total == 0:
        raise ValueError("empty: not a single point record")
    at = lambda byte: min(total, max(0, -(-(byte - head.body) // width)))
    return at(start), at(stop)


def _lines(file: RangeFile, head: PcdHeader, start: int, stop: int) -> Iterator[list[bytes]]:
    """Batches of the non-empty lines that begin inside a range of an ascii body."""
    at = max(start, head.body)
    skip = at > head.body  # look one byte back: the line around the border belongs to the range before
    at -= skip
    position, rest, out = at, b"", []
    while True:
        block = file.read(position, 1 << 20)
        position += len(block)
        parts = (rest + block).split(b"\n")
        rest = parts.pop() if block else b""
        for line in parts:
            begins, at = at, at + len(line) + 1
            if skip:
                skip = False
            elif begins >= stop:
                if out:
                    yield out
                return
            elif line.strip():
                out.append(line)
        if len(out) >= BATCH or (out and not block):
            yield out
            out = []
        if not block:
            return


def _numbers(lines: list[bytes], head: PcdHeader) -> np.ndarray:
    words = [line.split() for line in lines]
    width = sum(head.dtype[n].shape[0] for n in head.dtype.names)
    if any(len(w) != width for w in words):
        raise ValueError("a point row has more or fewer values than the header names")
    return np.array(words, dtype=np.float64)


def _count(path: str, start: int, stop: int) -> int:
    with RangeFile(path) as file:
        head = _header(file)
        if None in [head.field(a) for a in ("x", "y", "z")]:
            raise ValueError(f"x/y/z are not among the fields {list(head.dtype.names)}")
        if head.encoding == "binary":
            first, last = _records(file, head, start, stop)
            return last - first
        rows = sum(len(_numbers(lines, head)) for lines in _lines(file, head, start, stop))
        if rows == 0 and start == 0 and stop >= file.size:
            raise ValueError("empty: not a single point row")
        return rows


def _read(path: str, start: int, stop: int, before: int) -> Iterator[pd.DataFrame]:
    with RangeFile(path) as file:
        head = _header(file)
        if head.encoding == "binary":
            first, last = _records(file, head, start, stop)
            width = head.dtype.itemsize
            for at in range(first, last, BATCH):
                raw = file.read(head.body + at * width, min(BATCH, last - at) * width)
                yield head.frame(np.frombuffer(raw, dtype=head.dtype), at)
            return
        for lines in _lines(file, head, start, stop):
            if head.declared is not None:
                lines = lines[:max(0, head.declared - before)]  # rows beyond the declared count are dropped
            if not lines:
                return
            flat = _numbers(lines, head)
            points, left = np.zeros(len(flat), dtype=head.dtype), 0
            for name in head.dtype.names:
                width = head.dtype[name].shape[0]
                points[name] = flat[:, left:left + width].astype(head.dtype[name].base)
                left += width
            yield head.frame(points, before)
            before += len(lines)


def read_pcd(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(points, failures) of every .pcd file below ``path``; ``point_id`` numbers the points of a file from 0."""
    rows, failures = scan(file_splits(spark, path, ".pcd", split_bytes), _count, _read, COLUMNS)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", *NAMES), failures


def write_pcd(points: DataFrame, path: str, columns: list[str] | None = None, max_points: int = 1_000_000) -> None:
    """Ascii PCD files below ``path``, one per cloud and at most about ``max_points`` points each.

    A crowded cloud is written as several files (``part=1``, ``part=2``, ...), so no task writes a whole big cloud.
    """
    columns = columns or ["x", "y", "z"]
    size = F.count(F.lit(1))
    parts = points.groupBy("filename").agg(F.ceil(size / F.lit(max_points)).alias("_parts"), size.alias("_n"))
    rows = salted_join(points, parts, ["filename"], "_n").withColumn("part", F.pmod(F.hash(row_spread(points)), c("_parts")))
    sizes = rows.groupBy("filename", "part").agg(F.count(F.lit(1)).alias("_n"))
    many = lambda word: " ".join(word for _ in columns)
    n = c("_n").cast("string")
    head = F.array(
        F.lit("VERSION 0.7"), F.lit(f"FIELDS {' '.join(columns)}"), F.lit(f"SIZE {many('8')}"), F.lit(f"TYPE {many('F')}"), F.lit(f"COUNT {many('1')}"),
        F.concat(F.lit("WIDTH "), n), F.lit("HEIGHT 1"), F.lit("VIEWPOINT 0 0 0 1 0 0 0"), F.concat(F.lit("POINTS "), n), F.lit("DATA ascii"))
    cloud = F.regexp_replace("filename", r"\.[^.]+$", "").alias("cloud")
    heads = sizes.select(cloud, "part", F.posexplode(head).alias("_o", "value"))
    line = F.concat_ws(" ", *[c(k).cast("double").cast("string") for k in columns])
    lines = heads.unionByName(rows.select(cloud, "part", F.lit(99).alias("_o"), line.alias("value")))
    # one task per (cloud, part), header lines first; a one-column CSV is plain text with a chosen extension
    ordered = lines.repartition("cloud", "part").sortWithinPartitions("cloud", "part", "_o").select("cloud", "part", "value")
    ordered.write.mode("overwrite").partitionBy("cloud", "part").options(extension="pcd", quote="\u0000", sep="\u0001").csv(path)
