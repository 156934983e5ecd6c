"""Sparse scalar grids as DataFrames, and grids made from the tables at hand."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOG, LEVEL_SET = "fog", "level_set"

VOXEL = T.StructType([
    T.StructField("x", T.IntegerType(), False), T.StructField("y", T.IntegerType(), False), T.StructField("z", T.IntegerType(), False),
    T.StructField("value", T.DoubleType()), T.StructField("active", T.BooleanType()),
])


@dataclass(frozen=True)
class Grid:
    """Voxels (x, y, z, value, active) with what holds for all of them. Places without a row have the background value."""

    voxels: DataFrame
    grid_class: str = FOG
    background: float = 0.0
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    name: str = "density"

    def __post_init__(self):
        if self.grid_class not in (FOG, LEVEL_SET):
            raise ValueError("a surface needs a fog volume or a level set")

    def inside(self, value: Column, iso: float) -> Column:
        """Fog: at least iso; level set: at most iso."""
        return value >= F.lit(float(iso)) if self.grid_class == FOG else value <= F.lit(float(iso))

    def background_inside(self, iso: float) -> bool:
        return self.background >= iso if self.grid_class == FOG else self.background <= iso

    def outward(self) -> float:
        """Gradients point to larger values: outward in a level set, inward in fog."""
        return -1.0 if self.grid_class == FOG else 1.0

    def of(self, voxels: DataFrame) -> Grid:
        return replace(self, voxels=voxels)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_lineitem(spark: SparkSession, sf_dir: str, parts: int = 24, suppliers: int = 10) -> Grid:
    """Line items counted by part, supplier and day of the month: a fog volume of voxel size 0.31 x 0.31 x 1."""
    rows = table(spark, sf_dir, "lineitem")
    at = rows.select((F.col("l_partkey") % parts).cast("int").alias("x"), (F.col("l_suppkey") % suppliers).cast("int").alias("y"), F.dayofmonth("l_shipdate").alias("z"))
    counted = at.groupBy("x", "y", "z").agg(F.count("*").cast("double").alias("value"))
    return Grid(counted.withColumn("active", F.lit(True)), FOG, 0.0, (0.31, 0.31, 1.0))


def from_orders(spark: SparkSession, sf_dir: str) -> Grid:
    """Orders counted by customer, day and month: a second fog volume of unit voxels."""
    rows = table(spark, sf_dir, "orders")
    at = rows.select((F.col("o_custkey") % 24).cast("int").alias("x"), F.month("o_orderdate").alias("y"), F.dayofmonth("o_orderdate").alias("z"))
    return Grid(at.groupBy("x", "y", "z").agg(F.count("*").cast("double").alias("value")).withColumn("active", F.lit(True)))


def level_of(grid: Grid, factor: float = 1.5) -> float:
    """An iso value that follows the data: the mean value times ``factor``, rounded down."""
    return float(grid.voxels.agg(F.floor(F.avg("value") * factor).alias("iso")).first()["iso"] or 0)


def from_rows(spark: SparkSession, rows: list[tuple], **kwargs) -> Grid:
    """A grid of (x, y, z, value) rows, all active."""
    return Grid(spark.createDataFrame([(*r[:3], float(r[3]), True) for r in rows], VOXEL), **kwargs)


#: The same volumes for DuckDB.
SQL_VOXELS = """vox AS (
  SELECT CAST(l_partkey % 24 AS INTEGER) AS x, CAST(l_suppkey % 10 AS INTEGER) AS y, CAST(day(l_shipdate) AS INTEGER) AS z, CAST(count(*) AS DOUBLE) AS value
  FROM lineitem GROUP BY ALL),
iso AS (SELECT floor(avg(value) * 1.5) AS iso FROM vox)"""
SQL_ORDERS = """ovox AS (
  SELECT CAST(o_custkey % 24 AS INTEGER) AS x, CAST(month(o_orderdate) AS INTEGER) AS y, CAST(day(o_orderdate) AS INTEGER) AS z, CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY ALL)"""
