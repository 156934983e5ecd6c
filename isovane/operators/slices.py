"""Planes cut out of a grid: pixels, grey values, contour segments, sample overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.sources.voxels import Grid

#: Pixels of a slice; a larger one is refused, not cut.
MOST_PIXELS = 16_000_000
_PLANE = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}


def extract(grid: Grid, axis: str, index: int) -> tuple[DataFrame, int, int]:
    """(pixels (row, col, value), width, height) of the plane axis = index over the bounds of all active voxels.

    The pixel grid is generated in Spark and left-joined with the voxels of the plane; absent places are background.
    """
    across, up = _PLANE[axis]
    bounds = grid.voxels.where("active").agg(*[f(c) for c in (across, up) for f in (F.min, F.max)]).first()
    if bounds[0] is None:
        return grid.voxels.where("false").select(F.col("x").alias("row"), F.col("y").alias("col"), "value"), 0, 0
    width, height = bounds[1] - bounds[0] + 1, bounds[3] - bounds[2] + 1
    if width * height > MOST_PIXELS:
        raise ValueError(f"a slice of {width} x {height} pixels is too large")
    spark = grid.voxels.sparkSession
    pixels = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    plane = grid.voxels.where(F.col(axis) == index).select((F.col(up) - bounds[2]).alias("row"), (F.col(across) - bounds[0]).alias("col"), "value")
    return pixels.join(plane, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(grid.background)).alias("value")), width, height


def with_gray(pixels: DataFrame, most: float | None = None) -> DataFrame:
    """``pixels`` with ``gray``, 0 to 255; by the slice's own maximum unless one is given."""
    if most is None:
        most = pixels.agg(F.max("value")).first()[0] or 0.0
    return pixels.withColumn("gray", g.gray(F.col("value"), float(most)))


def contours(pixels: DataFrame, level: float, width: int, height: int) -> DataFrame:
    """(x0, y0, x1, y1, level): marching-squares segments, in 0..1 of the slice, y downward.

    A side is crossed where one end is below the level and the other is not. Cells with four crossings are
    separated by whether their mean reaches the level.
    """
    corners = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(r).alias("r"), F.lit(c).alias("c")) for i, (r, c) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    given = pixels.select(F.explode(corners).alias("o"), "row", "col", "value")
    cells = given.groupBy((F.col("row") - F.col("o.r")).alias("row"), (F.col("col") - F.col("o.c")).alias("col")).agg(*[F.max(F.when(F.col("o.k") == k, F.col("value"))).alias(f"v{k}") for k in range(4)])
    cells = cells.where(F.col("row").between(0, height - 2) & F.col("col").between(0, width - 2))
    v = [F.col(f"v{k}") for k in range(4)]
    at = [(F.col("col") + c, F.col("row") + r) for r, c in ((0, 0), (0, 1), (1, 1), (1, 0))]

    def side(k: int) -> Column:
        j = (k + 1) % 4
        t = g.crossing(v[k], v[j], level)
        x, y = (a + (b - a) * t for a, b in zip(at[k], at[j], strict=True))
        crossed = (v[k] < level) != (v[j] < level)
        return F.when(crossed, F.struct((x / F.lit(float(max(1, width - 1)))).alias("x"), (1.0 - y / F.lit(float(max(1, height - 1)))).alias("y")))

    hits = F.array_compact(F.array(*[side(k) for k in range(4)]))
    pair = lambda a, b: F.struct(F.get("hits", F.lit(a)).alias("a"), F.get("hits", F.lit(b)).alias("b"))
    full = sum(v[1:], v[0]) * 0.25 >= level
    segments = F.when(F.size("hits") == 2, F.array(pair(0, 1))).when((F.size("hits") == 4) & F.col("full"), F.array(pair(0, 3), pair(1, 2))).when(F.size("hits") == 4, F.array(pair(0, 1), pair(2, 3)))
    lines = cells.select(hits.alias("hits"), full.alias("full")).select(F.explode(segments).alias("s"))
    return lines.select("s.a.x", "s.a.y", "s.b.x", "s.b.y").toDF("x0", "y0", "x1", "y1").withColumn("level", F.lit(float(level)))


def levels(pixels: DataFrame, wanted: list[float], reference: float, width: int, height: int) -> DataFrame:
    """Contours at ``reference`` and at all ``wanted`` levels that differ from it, in one table."""
    out = contours(pixels, reference, width, height)
    for level in dict.fromkeys(wanted):
        if level != reference:
            out = out.unionByName(contours(pixels, level, width, height))
    return out


def overlay(samples: DataFrame, axis: str, index: int) -> DataFrame:
    """(row, col, kind) of the samples on a plane; core wins over transition."""
    across, up = _PLANE[axis]
    on = samples.where(F.col(axis) == index).select(F.col(up).alias("row"), F.col(across).alias("col"), F.when(F.col("kind") == "core", 2).otherwise(1).alias("rank"))
    return on.groupBy("row", "col").agg(F.max("rank").alias("rank")).select("row", "col", F.when(F.col("rank") == 2, "core").otherwise("transition").alias("kind"))
