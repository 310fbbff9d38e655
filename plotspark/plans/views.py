"""The engine's input shapes as views over the given tables, once for Spark and once as SQL for the checker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud per supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("field_plot("), c("l_suppkey").cast("string"), F.lit(").laz")).alias("filename"),
        c("l_suppkey").cast("int").alias("plot"),
        (c("l_orderkey") * 100000000 + c("l_partkey") * 10 + c("l_linenumber")).alias("point_id"),
        (c("l_quantity") / 10.0).alias("x"),
        (c("l_discount") * 10.0 + c("l_tax")).alias("y"),
        (F.lit(100.0) + c("l_extendedprice") / 50000.0).alias("z"),
        (c("l_extendedprice") / 50000.0).alias("height"),
        F.when(c("l_returnflag") == "A", 2).otherwise(1).alias("classification"),
        (c("l_partkey") % 256 * 257).cast("int").alias("red"),
        (c("l_orderkey") % 256 * 257).cast("int").alias("green"),
        (c("l_linenumber") * 257).cast("int").alias("blue"),
    )


def mask_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping diamonds, one per nation."""
    corner = F.explode(F.array(*[
        F.struct(F.lit(seq).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for seq, dx, dy in ((1, -0.63, 0.0), (2, 0.0, -0.17), (3, 0.63, 0.0), (4, 0.0, 0.17))
    ])).alias("v")
    return table(spark, sf_dir, "nation").select("n_nationkey", corner).select(
        c("n_nationkey").cast("int").alias("label"), c("v.seq").alias("seq"),
        (F.lit(0.5) + (c("n_nationkey") % 5) * 1.0 + c("v.dx")).alias("x"),
        (F.lit(0.1) + F.floor(c("n_nationkey") / 5.0) * 0.2 + c("v.dy")).alias("y"),
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotspark.sources.masks import masks_from_vertices

    return masks_from_vertices(mask_vertices(spark, sf_dir))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference sheet in which every key occurs once per stage."""
    stage = F.explode(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(k).alias("k"), F.lit(ord_).alias("ord"))
        for name, k, ord_ in (("Z31", 1.0, 0), ("Z65", 3.0, 1))
    ])).alias("st")
    return table(spark, sf_dir, "supplier").where(c("s_suppkey") % 10 != 7).select("*", stage).select(
        c("s_name").alias("label"), c("st.stage").alias("stage"), c("s_nationkey").cast("int").alias("block"),
        (c("s_acctbal") * c("st.k")).alias("biomass"), (c("s_suppkey") * 2 + c("st.ord")).alias("row_no"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import file names with row and column numbers, some of them taken twice."""
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("file_no"),
        F.concat(c("p_size").cast("string"), F.lit("-"), (c("p_partkey") % 18 + 1).cast("string"), F.lit("-1-b.pcd")).alias("name"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long prediction table: model, split, plot, aug, role, actual, predicted."""
    plot = F.floor(c("o_orderkey") / 12.0)
    actual = c("o_totalprice") / 1000.0
    return table(spark, sf_dir, "orders").select(
        c("o_orderpriority").alias("model"), (c("o_orderkey") % 4 + 1).cast("int").alias("split"), plot.cast("int").alias("plot"),
        (c("o_orderkey") % 3).cast("int").alias("aug"),
        F.when(plot % 4 == c("o_orderkey") % 4, F.lit("V")).otherwise(F.lit("T")).alias("role"),
        actual.alias("actual"), (actual * (F.lit(0.9) + (c("o_custkey") % 21) / 100.0)).alias("predicted"),
    )


def dataset(spark: SparkSession, sf_dir: str, dims: int = 4) -> DataFrame:
    """Feature table with augmented copies and a target; the features are the first ``dims`` of the embedding."""
    copy = F.floor(c("vec_id") / 100.0).cast("int")
    plot = c("vec_id") % 100 + 1
    f = [F.element_at("embedding", i + 1).cast("double") for i in range(dims)]
    suffix = F.when(c("vec_id") >= 100, F.concat(F.lit("_aug("), copy.cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return table(spark, sf_dir, "embeddings").select(
        plot.cast("int").alias("plot"), copy.alias("aug"),
        F.concat(F.lit("field_plot("), plot.cast("string"), F.lit(")"), suffix, F.lit(".laz")).alias("filename"),
        *[f[i].alias(f"f{i}") for i in range(dims)],
        (F.lit(200.0) + 30.0 * f[0] - 10.0 * f[1] + c("label")).alias("target"),
    )


SQL_VIEWS = {
    "v_points": """
SELECT concat('field_plot(', CAST(l_suppkey AS VARCHAR), ').laz') AS filename, CAST(l_suppkey AS INT) AS plot,
       l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS point_id,
       l_quantity / 10e0 AS x, l_discount * 10e0 + l_tax AS y, 100e0 + l_extendedprice / 50000e0 AS z,
       l_extendedprice / 50000e0 AS height, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS classification,
       CAST(l_partkey % 256 * 257 AS INT) AS red, CAST(l_orderkey % 256 * 257 AS INT) AS green, CAST(l_linenumber * 257 AS INT) AS blue
FROM lineitem""",
    "v_mask_vertices": """
SELECT CAST(n_nationkey AS INT) AS label, v.seq, 0.5e0 + (n_nationkey % 5) * 1e0 + v.dx AS x,
       0.1e0 + floor(n_nationkey / 5e0) * 0.2e0 + v.dy AS y
FROM nation CROSS JOIN (VALUES (1, -0.63e0, 0e0), (2, 0e0, -0.17e0), (3, 0.63e0, 0e0), (4, 0e0, 0.17e0)) AS v(seq, dx, dy)""",
    "v_reference": """
SELECT s_name AS label, st.stage, CAST(s_nationkey AS INT) AS block, s_acctbal * st.k AS biomass, s_suppkey * 2 + st.ord AS row_no
FROM supplier CROSS JOIN (VALUES ('Z31', 1e0, 0), ('Z65', 3e0, 1)) AS st(stage, k, ord) WHERE s_suppkey % 10 <> 7""",
    "v_names": """
SELECT p_partkey AS file_no, concat(CAST(p_size AS VARCHAR), '-', CAST(p_partkey % 18 + 1 AS VARCHAR), '-1-b.pcd') AS name FROM part""",
    "v_predictions": """
SELECT o_orderpriority AS model, CAST(o_orderkey % 4 + 1 AS INT) AS split, CAST(floor(o_orderkey / 12e0) AS INT) AS plot,
       CAST(o_orderkey % 3 AS INT) AS aug, CASE WHEN floor(o_orderkey / 12e0) % 4 = o_orderkey % 4 THEN 'V' ELSE 'T' END AS role,
       o_totalprice / 1000e0 AS actual, o_totalprice / 1000e0 * (0.9e0 + (o_custkey % 21) / 100e0) AS predicted
FROM orders""",
    "v_dataset": """
SELECT CAST(vec_id % 100 + 1 AS INT) AS plot, CAST(floor(vec_id / 100e0) AS INT) AS aug,
       concat('field_plot(', CAST(vec_id % 100 + 1 AS VARCHAR), ')', CASE WHEN vec_id >= 100 THEN concat('_aug(', CAST(CAST(floor(vec_id / 100e0) AS INT) AS VARCHAR), ')') ELSE '' END, '.laz') AS filename,
       CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2, CAST(embedding[4] AS DOUBLE) AS f3,
       200e0 + 30e0 * CAST(embedding[1] AS DOUBLE) - 10e0 * CAST(embedding[2] AS DOUBLE) + label AS target
FROM embeddings""",
}


def with_views(body: str, *views: str, ctes: str = "") -> str:
    """``body`` behind the named views (and further common table expressions) as one statement."""
    parts = [f"{name} AS ({SQL_VIEWS[name]})" for name in views]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
