import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotspark.sources.las import header_counts, read_las
from plotspark.sources.pcd import read_pcd, write_pcd

c = F.col


def pcd(path, fields, rows, data="ascii", points=None, types=None, sizes=None, extra=""):
    types, sizes = types or ["F"] * len(fields), sizes or [4] * len(fields)
    n = len(rows) if points is None else points
    head = f"# comment\nVERSION 0.7\nFIELDS {' '.join(fields)}\nSIZE {' '.join(map(str, sizes))}\nTYPE {' '.join(types)}\nCOUNT {' '.join('1' for _ in fields)}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA {data}\n"
    if data == "binary":
        codes = {("F", 4): "f", ("F", 8): "d", ("U", 1): "B", ("U", 2): "H", ("I", 4): "i", ("U", 4): "I"}
        body = b"".join(struct.pack("<" + "".join(codes[(t, s)] for t, s in zip(types, sizes)), *row) for row in rows)
    else:
        body = ("\n".join(" ".join(str(v) for v in row) for row in rows) + "\n").encode()
    path.write_bytes(head.encode() + body + extra.encode())


@pytest.mark.parametrize("split_bytes", [1 << 20, 300])
def test_ascii_and_binary_agree(spark, tmp_path, split_bytes):
    rng = np.random.default_rng(0)
    rows = [tuple(float(np.float32(v)) for v in r) for r in rng.uniform(-5, 200000, (97, 4))]
    pcd(tmp_path / "a.pcd", ["x", "y", "z", "intensity"], rows)
    pcd(tmp_path / "b.PCD", ["x", "y", "z", "intensity"], rows, "binary")
    points, failures = read_pcd(spark, str(tmp_path), split_bytes)
    assert failures.count() == 0
    got = points.toPandas().sort_values(["filename", "point_id"])
    for name in ("a.pcd", "b.PCD"):
        part = got[got["filename"] == name]
        assert list(part["point_id"]) == list(range(97)) and np.allclose(part[["x", "y", "z"]].to_numpy(), np.array(rows)[:, :3], rtol=0, atol=0)
        assert list(part["intensity"]) == [int(np.clip(np.rint(r[3]), 0, 65535)) for r in rows] and set(part["classification"]) == {1}
        assert part["red"].isna().all()


def test_channels_and_extra_rows(spark, tmp_path):
    fields = ["x", "y", "z", "R", "green", "b", "Label", "_", "_"]
    pcd(tmp_path / "c.pcd", fields, [(1, 2, 3, 255, 0, 300.4, 2, 9, 9)] * 3, points=2)
    pcd(tmp_path / "d.pcd", ["x", "y", "z", "r", "g"], [(1, 2, 3, 4, 5)])
    got = read_pcd(spark, str(tmp_path))[0].toPandas().set_index("filename")
    assert len(got.loc[["c.pcd"]]) == 2  # rows beyond POINTS are dropped
    row = got.loc[["c.pcd"]].iloc[0]
    assert (row["red"], row["green"], row["blue"], row["classification"]) == (65535, 0, 65535, 2)
    assert np.isnan(got.loc["d.pcd", "red"])  # colour needs all three channels


def test_bad_files_become_failures(spark, tmp_path):
    good = [(1, 2, 3)] * 4
    pcd(tmp_path / "ok.pcd", ["x", "y", "z"], good)
    pcd(tmp_path / "short.pcd", ["x", "y", "z"], good, "binary", points=9)
    pcd(tmp_path / "packed.pcd", ["x", "y", "z"], good, "binary_compressed")
    pcd(tmp_path / "flat.pcd", ["x", "y"], [(1, 2)])
    pcd(tmp_path / "ragged.pcd", ["x", "y", "z"], good, extra="1 2\n")
    pcd(tmp_path / "empty.pcd", ["x", "y", "z"], [])
    (tmp_path / "cut.pcd").write_bytes(b"VERSION 0.7\nFIELDS x")
    points, failures = read_pcd(spark, str(tmp_path))
    assert {r["filename"] for r in points.select("filename").distinct().collect()} == {"ok.pcd"}
    reasons = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in failures.collect()}
    assert set(reasons) == {"short.pcd", "packed.pcd", "flat.pcd", "ragged.pcd", "empty.pcd", "cut.pcd"}
    assert "truncated" in reasons["short.pcd"] and "not supported" in reasons["packed.pcd"] and "x/y/z" in reasons["flat.pcd"]


def test_written_clouds_read_back(spark, cloud, tmp_path):
    pts = cloud([{"x": i / 3, "y": i, "z": -i} for i in range(50)], "plot(5).laz")
    write_pcd(pts, str(tmp_path / "out"), max_points=20)
    points, failures = read_pcd(spark, str(tmp_path / "out"))
    assert failures.count() == 0 and points.select("path").distinct().count() > 1
    assert sorted(r["x"] for r in points.collect()) == [i / 3 for i in range(50)]


def las(path, fmt=3, minor=2, n=None, rows=None, extra=True, scale=0.001):
    rows = rows or [(1.0, 2.0, 3.0, 7, 1, (10, 20, 30), 0.5), (4.5, -2.25, 3.125, 9, 2 | 0x20, (99, 99, 99), 0.25)]
    sizes = {0: 20, 1: 28, 2: 26, 3: 34, 6: 30, 7: 36}
    vlr = b""
    if extra:
        dim = bytearray(192)
        dim[2], dim[4:18] = 9, b"RelativeHeight"
        vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, 192, b"") + bytes(dim)
    header = bytearray(375 if minor >= 4 else 227)
    header[0:4], header[24], header[25] = b"LASF", 1, minor
    struct.pack_into("<HII", header, 94, len(header), len(header) + len(vlr), 1 if extra else 0)
    length = sizes[fmt & 63] + (4 if extra else 0)
    count = len(rows) if n is None else n
    struct.pack_into("<BHI", header, 104, fmt, length, 0 if minor >= 4 else count)
    struct.pack_into("<3d", header, 131, scale, scale, scale)
    struct.pack_into("<3d", header, 155, 100.0, 0.0, 0.0)
    if minor >= 4:
        struct.pack_into("<Q", header, 247, count)
    body = b""
    for x, y, z, intensity, label, rgb, h in rows:
        rec = bytearray(length)
        struct.pack_into("<iiiH", rec, 0, round((x - 100) / scale), round(y / scale), round(z / scale), intensity)
        rec[16 if fmt >= 6 else 15] = label
        colour = {2: 20, 3: 28, 7: 30}.get(fmt)
        if colour:
            struct.pack_into("<3H", rec, colour, *rgb)
        if extra:
            struct.pack_into("<f", rec, length - 4, h)
        body += bytes(rec)
    path.write_bytes(bytes(header) + vlr + body)


@pytest.mark.parametrize("fmt, minor", [(0, 2), (1, 2), (2, 3), (3, 2), (6, 4), (7, 4)])
def test_las_formats(spark, tmp_path, fmt, minor):
    las(tmp_path / "p.las", fmt, minor)
    points, failures = read_las(spark, str(tmp_path))
    assert failures.count() == 0
    got = points.orderBy("point_id").collect()
    assert [(r["x"], r["y"], r["z"]) for r in got] == [pytest.approx((1.0, 2.0, 3.0)), pytest.approx((4.5, -2.25, 3.125))]
    assert [r["classification"] for r in got] == ([1, 2] if fmt < 6 else [1, 34]) and [r["intensity"] for r in got] == [7, 9]
    assert (got[0]["red"] == 10) if fmt in (2, 3, 7) else got[0]["red"] is None
    assert got[0]["extra"] == {"RelativeHeight": 0.5}


def test_las_ranges_and_failures(spark, tmp_path):
    rows = [(float(i), 0.0, 0.0, i, 1, (0, 0, 0), 0.0) for i in range(60)]
    las(tmp_path / "big.las", rows=rows)
    las(tmp_path / "cut.las", n=50)
    las(tmp_path / "zip.las", fmt=3 | 128)
    (tmp_path / "junk.las").write_bytes(b"nonsense")
    points, failures = read_las(spark, str(tmp_path), split_bytes=500)
    assert sorted(r["intensity"] for r in points.collect()) == list(range(60))
    assert {r["path"].rsplit("/", 1)[-1] for r in failures.collect()} == {"cut.las", "zip.las", "junk.las"}
    assert {r["path"].rsplit("/", 1)[-1]: r["points"] for r in header_counts(spark, str(tmp_path)).collect()} == {
        "big.las": 60, "cut.las": 50, "zip.las": 0, "junk.las": 0}


def test_las_feeds_the_features(spark, tmp_path):
    from plotspark.config import FeatureConfig
    from plotspark.operators.features import compute_features

    las(tmp_path / "plot(3).las", rows=[(0.0, 0.0, 0.0, 1, 1, (10, 20, 30), h) for h in (0.5, 1.0, 1.5, 2.0)] + [(0.0, 0.0, 0.0, 1, 2, (99, 99, 99), 0.0)] * 2)
    row = compute_features(read_las(spark, str(tmp_path))[0], ["h_mean", "ppr", "R_mean"], FeatureConfig(height="RelativeHeight")).first()
    assert (row["h_mean"], row["ppr"], row["R_mean"]) == (1.25, pytest.approx(1 / 3), 10)


def test_geopackage(spark, tmp_path):
    import sqlite3

    from plotspark.functions.naming import LabelFormat
    from plotspark.sources.geopackage import read_geopackage
    from plotspark.sources.masks import load_masks

    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    multi = struct.pack("<BII", 1, 6, 2) + wkb + wkb
    blob = lambda body: b"GP\x00\x01" + struct.pack("<i", 32636) + body
    con = sqlite3.connect(tmp_path / "m.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('plots', 'geom')")
    con.execute("CREATE TABLE plots (fid INTEGER, tag TEXT, geom BLOB)")
    con.executemany("INSERT INTO plots VALUES (?, ?, ?)", [(1, "P_7", blob(wkb)), (2, "P_8", blob(multi)), (3, "P_9", None), (4, "x", blob(wkb))])
    con.commit()
    con.close()
    masks, unreadable = load_masks(read_geopackage(spark, str(tmp_path)), "tag", LabelFormat("P_", ""))
    assert {r["label"]: (len(r["rings"]), r["maxx"]) for r in masks.collect()} == {7: (1, 10.0), 8: (2, 10.0)}
    assert [r["label_text"] for r in unreadable.collect()] == ["x"]


def test_reference_sheets(spark, tmp_path):
    from plotspark.operators.keys import key_sheet
    from plotspark.sources.reference import list_reference_columns, read_reference

    path = tmp_path / "sheet.csv"
    path.write_text("plot,biomass,note,empty\n429,1.5,a,\n430,2.5,,\n429,9.5,b,\n")
    assert list_reference_columns(spark, str(path)) == ["plot", "biomass", "note"]
    from plotspark.operators.encode import first_rows

    keyed = key_sheet(read_reference(spark, str(path)), "plot")
    assert {r["plot"]: r["biomass"] for r in first_rows(keyed, ["biomass"]).collect()} == {429: 1.5, 430: 2.5}
    path.write_text("plot,empty\n1,\n")
    with pytest.raises(ValueError):
        read_reference(spark, str(path))


def test_commented_csv(spark, tmp_path):
    from plotspark.sinks import read_commented_csv, with_comments, write_commented_csv

    df = with_comments(spark.createDataFrame([(f"p{i}", i / 7) for i in range(20)], "filename string, h_mean double").repartition(3), {"h_mean": "mean height"})
    write_commented_csv(df, str(tmp_path / "t"), ["run 1"])
    text = next((tmp_path / "t").glob("part-*")).read_text().splitlines()
    assert text[:3] == ["# run 1", "# h_mean: mean height", "filename,h_mean"]
    back = read_commented_csv(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    df.write.parquet(str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).schema["h_mean"].metadata == {"comment": "mean height"}


def test_listings(spark, tmp_path):
    from plotspark.sources.listing import file_map, list_sources, natural_order, previous_output

    for name in ("run10/plot(1).las", "run2/plot(10).laz", "run2/plot(2)_aug(1).laz", "run2/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    ordered = natural_order(list_sources(spark, str(tmp_path))).orderBy("place").collect()
    assert [r["path"].split("/run", 1)[1] for r in ordered] == ["2/plot(2)_aug(1).laz", "2/plot(10).laz", "10/plot(1).las"]
    paths = spark.createDataFrame([("b/plot(1).laz",), ("a/plot(1).laz",), ("a/plot(1)_aug(2).laz",), ("a/x.laz",)], "path string")
    assert {(r["plot"], r["aug"]): r["path"] for r in file_map(paths).collect()} == {(1, 0): "a/plot(1).laz", (1, 2): "a/plot(1)_aug(2).laz"}
    assert file_map(paths, originals_only=True).count() == 1
    clouds, has_manifest = previous_output(spark, str(tmp_path))
    assert clouds.count() == 3 and not has_manifest
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_bytes(b"x")
    with pytest.raises(FileNotFoundError):
        previous_output(spark, str(tmp_path / "none"))


def test_run_listing(spark):
    from plotspark.sinks import list_runs

    runs = spark.createDataFrame([("pls", "2024-01-02", 12.345, "biomass", False, False), ("knn", "2024-03-01", 9.0, "biomass", True, True), (None, None, None, None, None, None)],
                                 "model string, saved_at string, rrmse double, target string, augmented boolean, nested boolean")
    assert [r["label"] for r in list_runs(runs).collect()] == [
        "[ML] knn (AUG) (nested CV) — biomass (rRMSE 9%, 2024-03-01)", "[ML] pls — biomass (rRMSE 12.3%, 2024-01-02)"]
