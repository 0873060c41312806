"""The driver's tables seen as points, votes, depth samples and a raster; DataFrames, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64  #: the raster's width and height


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z and a survey class of each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"),
        ((F.col("o_custkey") % 1500).cast("double") * 0.004).alias("x"),
        ((F.round(F.col("o_totalprice") * 100.0).cast("long") % 1000).cast("double") * 0.005).alias("y"),
        ((F.col("o_orderkey") * 7919 % 1000).cast("double") * 0.005).alias("z"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("las_class"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id and class_id of each mask-pixel hit: one for each line item; class 0 is unclassified."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_id"), (flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).alias("class_id"))


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One depth sample for each line item."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 0.2 + F.col("l_discount") * 20.0 + 5.0).alias("d"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, py, v, al of every pixel of a SIDE x SIDE raster.

    All points are drawn from above; al is 1 where the point with the least z is of
    class 1 or 2, whose class gives v.  The other pixels are holes.
    """
    place = [(F.floor(F.col("x") * 10.0) % SIDE).cast("int").alias("px"), (F.floor(F.col("y") * 12.0) % SIDE).cast("int").alias("py")]
    top = points(spark, sf_dir).groupBy(*place).agg(F.min(F.struct("z", "point_id", "las_class")).alias("top"))
    lit = top.where("top.las_class <= 2").select("px", "py", (F.col("top.las_class") * F.lit(0.25)).alias("v0"))
    grid = spark.range(SIDE * SIDE).select((F.col("id") % SIDE).cast("int").alias("px"), F.floor(F.col("id") / SIDE).cast("int").alias("py"))
    return grid.join(lit, ["px", "py"], "left").select("px", "py", F.coalesce("v0", F.lit(0.0)).alias("v"), F.when(F.col("v0").isNull(), 0.0).otherwise(1.0).alias("al"))


POINTS = """points AS (SELECT o_orderkey AS point_id, CAST(o_custkey % 1500 AS DOUBLE) * 0.004e0 AS x,
    CAST(CAST(ROUND(o_totalprice * 100.0e0) AS BIGINT) % 1000 AS DOUBLE) * 0.005e0 AS y, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) * 0.005e0 AS z,
    CAST(SUBSTRING(o_orderpriority, 1, 1) AS INT) AS las_class FROM orders)"""
HITS = """hits AS (SELECT l_orderkey AS point_id, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS class_id FROM lineitem)"""
DEPTHS = "depths AS (SELECT l_quantity * 0.2e0 + l_discount * 20.0e0 + 5.0e0 AS d FROM lineitem)"
RASTER = f"""{POINTS},
    drawn AS (SELECT CAST(FLOOR(x * 10.0e0) AS INT) % {SIDE} AS px, CAST(FLOOR(y * 12.0e0) AS INT) % {SIDE} AS py, z, point_id, las_class FROM points),
    tops AS (SELECT px, py, las_class, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM drawn),
    peak AS (SELECT px, py, las_class * 0.25e0 AS v0 FROM tops WHERE k = 1 AND las_class <= 2),
    raster AS (SELECT g.px, g.py, COALESCE(v0, 0e0) AS v, CASE WHEN v0 IS NULL THEN 0e0 ELSE 1e0 END AS al
        FROM (SELECT CAST(range % {SIDE} AS INT) AS px, CAST(range // {SIDE} AS INT) AS py FROM range({SIDE * SIDE})) g LEFT JOIN peak USING (px, py))"""


def micro(x: str) -> str:
    """Quantised to millionths, as a 64-bit integer: the last bits of transcendental functions and sums differ between engines."""
    return f"CAST(FLOOR(({x}) * 1e6 + 0.5e0) AS BIGINT)"


def micros(c: Column) -> Column:
    """micro() of a column."""
    return F.floor(c * 1e6 + 0.5).cast("long")
