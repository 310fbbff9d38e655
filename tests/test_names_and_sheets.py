import pytest
from pyspark.sql import functions as F

from plotspark.functions import naming, scalars
from plotspark.functions.naming import KeyFormat, LabelFormat
from plotspark.operators import encode, keys

c = F.col


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(c("v")).alias("o")).collect()]


def test_numbers_in_names(spark):
    names = ["test_plot(429).laz", "PLOT( 12 ).las", "notes.las", "x_plot(3)_aug(7).laz", None]
    assert column(spark, names, naming.plot_number) == [429, 12, None, 3, None]
    assert column(spark, names, naming.aug_number) == [None, None, None, 7, None]
    assert column(spark, names, naming.aug_level) == [0, 0, 0, 7, 0]


def test_labels(spark):
    texts = ["P_429.laz", "430", "430.0", " 7 ", "nothing", "p_-3x", "1.5"]
    assert column(spark, texts, lambda v: naming.label_number(v, LabelFormat("P_", ""))) == [429, 430, 430, 7, None, -3, None]
    assert column(spark, ["plot(7).laz", "nothing"], naming.label_number) == [7, None]
    assert column(spark, ["a.b(5)c"], lambda v: naming.label_number(v, LabelFormat("a.b(", ")"))) == [5]  # format text is literal


def test_built_names(spark):
    assert column(spark, ["field_plot(429).laz"], lambda v: naming.aug_name(v, F.lit(7))) == ["field_plot(429)_aug(7).laz"]
    assert column(spark, ["dir/field_plot(429).las", ".hidden"], naming.copy_name) == ["field_plot(429).laz", ".hidden.laz"]
    assert column(spark, ["429"], lambda v: naming.plot_name(v, "_siteA")) == ["plot(429)_siteA.laz"]


def test_natural_order(spark):
    paths = ["run2/plot10.las", "run10/plot1.las", "run2/Plot2.las", "10.las", "9.las"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(naming.natural_key(c("p")))
    assert [r["p"] for r in df.collect()] == ["9.las", "10.las", "run2/Plot2.las", "run2/plot10.las", "run10/plot1.las"]


@pytest.mark.parametrize("widest, stride", [(9, 10), (10, 100), (18, 100), (99, 100), (100, 1000), (0, 10)])
def test_stride(spark, widest, stride):
    df = spark.createDataFrame([(widest,), (0,)], "col int")
    assert keys.key_stride(df).first()["stride"] == stride
    assert keys.key_stride(df.where("col < 0")).first()["stride"] == 10


FMT = KeyFormat(col=LabelFormat("-", "-1-b"), row=LabelFormat("", "-"))


def test_import_plan(spark):
    files = spark.createDataFrame([(0, "1-12-1-b.pcd"), (1, "2-12-1-b.pcd"), (2, "2-12-1-b.las"), (3, "notes.las")], "file_no int, name string")
    plan = keys.plan_import(files, "name", FMT)
    assert {(r["name"], r["number"]) for r in plan.entries.collect()} == {("1-12-1-b.pcd", 112), ("2-12-1-b.pcd", 212), ("2-12-1-b.las", 212)}
    assert [r["name"] for r in plan.unreadable.collect()] == ["notes.las"]
    assert {r["name"] for r in plan.duplicates.collect()} == {"2-12-1-b.pcd", "2-12-1-b.las"}
    assert plan.is_clean.first()["is_clean"] is False
    assert {r["number"]: r["name"] for r in keys.surviving_files(plan.entries, "file_no").collect()}[212] == "2-12-1-b.las"
    single = keys.plan_import(spark.createDataFrame([("plot(3).las",), ("other_plot(3).las",)], "name string"), "name", KeyFormat())
    assert {r["number"] for r in single.entries.collect()} == {3}


def test_names_are_read_once(spark):
    files = spark.createDataFrame([(0, "1-12-1-b.pcd"), (1, "2-12-1-b.pcd")], "file_no int, name string")
    key = files.select(naming.plot_key(naming.stem(c("name")), FMT).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert key.count("regexp_replace") <= 2 and key.count("regexp_extract") <= 4  # two patterns for each of two numbers
    assert "InMemoryRelation" in keys.plan_import(files, "name", FMT).duplicates._jdf.queryExecution().withCachedData().toString()
    assert [r["col"] for r in keys.plan_import(files, "name", FMT).entries.orderBy("file_no").collect()] == [12, 12]


SHEET = [(429, 1, "T", 74.0, 0), (430, 2, "T", 78.0, 1), (431, 3, "M", 61.0, 2)]


def sheet(spark, rows=SHEET):
    return spark.createDataFrame(rows, "`F.PLT` int, Block int, Species string, height double, row_no int").withColumnRenamed("F.PLT", "plot_no")


def test_lookup_takes_the_first_row(spark):
    keyed = keys.key_sheet(sheet(spark, SHEET + [(429, 9, "M", 99.0, 3)]), "plot_no")
    files = spark.createDataFrame([("a", 429), ("b", 500), ("c", None)], "filename string, plot int")
    got = {r["filename"]: (r["Block"], r["height"]) for r in encode.lookup(files, keyed, ["Block", "height"]).collect()}
    assert got == {"a": (1, 74.0), "b": (None, None), "c": (None, None)}
    assert [tuple(r) for r in keyed.duplicate_keys.collect()] == [(429, 2)]
    assert keys.key_sheet(sheet(spark), "no such column").key_column == "plot_no"


def test_paired_keys_use_the_same_packing(spark):
    pairs = spark.createDataFrame([(1, 12, "Z31", 5.0, 0), (2, 12, "Z31", 6.0, 1)], "runNo int, rangeNo int, stage string, biomass double, row_no int")
    keyed = keys.key_sheet(pairs, "rangeNo", row_column="runNo")
    assert {r["plot"]: r["biomass"] for r in keyed.frame.collect()} == {112: 5.0, 212: 6.0}
    assert "runNo" not in keyed.columns and "rangeNo" not in keyed.columns
    wide = keys.key_sheet(pairs, "rangeNo", row_column="runNo", stride=1000)
    assert {r["plot"] for r in wide.frame.collect()} == {1012, 2012}


def test_row_filter(spark):
    data = sheet(spark)
    assert encode.keep_rows(data, "Species", " T ").count() == 2
    assert encode.keep_rows(data, "Species", "").count() == 3 and encode.keep_rows(data, "missing", "T").count() == 3
    with pytest.raises(ValueError, match="M, T"):
        encode.keep_rows(data, "Species", "X")
    with pytest.raises(ValueError):  # compared as text: 61 is not 61.0
        encode.keep_rows(data, "height", "61")
    assert sorted(r["value"] for r in encode.column_values(data, "Block").collect()) == ["1", "2", "3"]


def test_one_hot(spark):
    keyed = keys.key_sheet(sheet(spark), "plot_no")
    files = spark.createDataFrame([("a", 429), ("b", 431), ("c", 999)], "filename string, plot int")
    table = encode.one_hot(encode.lookup(files, keyed, ["Species", "Block"]).drop("plot"), keyed, ["Species"])
    assert table.columns == ["filename", "Species=M", "Species=T", "Block"]
    got = {r["filename"]: (r["Species=M"], r["Species=T"]) for r in table.collect()}
    assert got == {"a": (0.0, 1.0), "b": (1.0, 0.0), "c": (None, None)}
    many = keys.key_sheet(spark.range(101).select(c("id").alias("plot_no"), c("id").alias("kind"), c("id").alias("row_no")), "plot_no")
    with pytest.raises(ValueError, match="100"):
        encode.one_hot(encode.lookup(files, many, ["kind"]), many, ["kind"])


def test_match_report(spark):
    keyed = keys.key_sheet(sheet(spark, SHEET + [(429, 9, "M", 99.0, 3)]), "plot_no")
    plots = spark.createDataFrame([(429,), (429,), (500,), (None,)], "plot int")
    assert encode.match_report(plots, keyed).first().asDict() == {
        "sheet_rows": 4, "sheet_columns": 3, "duplicate_keys": 1, "plots": 2, "matched": 1, "unmatched": 1}
    assert [r["plot"] for r in encode.unmatched_plots(plots, keyed).collect()] == [500]


def test_feature_tables_keep_the_target_out(spark, cloud):
    keyed = keys.key_sheet(sheet(spark), "plot_no")
    pts = cloud([{"height": 1}, {"height": 3}], "plot(429).laz").unionByName(cloud([{"height": 5}], "plot(7).laz"))
    tables = encode.feature_tables(pts, ["h_mean"], keyed, ["Species", "height", "Block"], ["Species"], target="height")
    assert tables.x.columns == ["filename", "h_mean", "Species=M", "Species=T", "Block"]
    assert {r["filename"]: r["height"] for r in tables.y.collect()} == {"plot(429).laz": 74.0, "plot(7).laz": None}
    joined = encode.join_target(tables.x, tables.y)
    assert joined.columns[-1] == "height" and tables.failures.count() == 0


def test_column_resolution():
    universe = ["a", "b", "c"]
    assert encode.resolve_columns(universe, ["c", "a", "x"], ["a"]) == ["a", "c"]
    assert encode.resolve_columns(universe, [], ["b"]) == ["a", "c"] and encode.resolve_columns(universe) == universe
    assert encode.resolve_columns(universe, default_on=False) == []


def test_units(spark):
    texts = ["feet -> METRES", "Millimetres → metres", "cubits"]
    assert column(spark, texts, scalars.unit_scale) == [0.3048, 0.001, 1.0]


@pytest.mark.parametrize("digits", [2, 3, 4])
def test_general_format_matches_percent_g(spark, digits):
    values = [0.0, 1.0, 37.2134, 0.00012345, 0.0000123456, 123456.0, 9999.6, -0.5, 1e20, 100.0, 0.1, 2.5e-7, 999.96, 379.45, 0.15, 2.5, 0.125, 9.995, 99.95, 0.00009996, -1.005, 1e5]
    assert column(spark, values, lambda v: scalars.general_format(v, digits), "double") == [f"{v:.{digits}g}" for v in values]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_format_matches_percent_f(spark, digits):
    values = [379.45, 0.15, 2.5, 3.5, 0.125, -0.375, 4703.95, 1e15, 0.0, -0.04, 12345.678]
    assert column(spark, values, lambda v: scalars.fixed_format(v, digits), "double") == [f"{v:.{digits}f}" for v in values]
    assert column(spark, values, lambda v: scalars.fixed_format(v, digits, plus=True), "double") == [f"{v:+.{digits}f}" for v in values]


def test_display_values(spark):
    values = [float("nan"), None, 1234.5, 0.001, 0.0, -3.14159]
    assert column(spark, values, lambda v: scalars.display_value(v, "raw"), "double") == ["", "", "1.2e+03", "0.001", "0.0", "-3.1"]
    assert column(spark, [1.234, -0.5], lambda v: scalars.display_value(v, "z"), "double") == ["+1.23", "-0.50"]
    assert column(spark, [55.6], lambda v: scalars.display_value(v, "percentile"), "double") == ["56%"]
    assert column(spark, [429.0], lambda v: scalars.display_value(v, "raw", True), "double") == ["429"]


def test_flags(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, None), (None, True), (True, None)], "s boolean, h boolean")
    assert [r[0] for r in df.select(scalars.effective_aug(c("s"), c("h"))).collect()] == [False, True, False, None, True]


def test_box_angle(spark):
    df = spark.sql("SELECT array(struct(0D AS x, 0D AS y), struct(4D AS x, 4D AS y), struct(3D AS x, 5D AS y), struct(-1D AS x, 1D AS y)) AS k")
    row = df.select(scalars.box_angle(c("k")).alias("a"), *[s.alias(n) for s, n in zip(scalars.box_sides(c("k")), ("s", "l"))]).first()
    assert row["a"] == pytest.approx(45) and row["s"] == pytest.approx(2 ** 0.5) and row["l"] == pytest.approx(32 ** 0.5)


def test_safe_run_name(spark):
    assert column(spark, [" my run? v1.2", "../x/y", "  ", "été-3."], scalars.safe_run_name) == ["my_run_v1.2", "x_y", "", "été-3"]
