"""Meshes met in space: the narrow band of voxels around a mesh, and tables of rays against triangles.

Both bin triangles into cells and compare only what shares one; large triangles are split by cells, rays by the cells that
they cross, so no task holds a whole mesh and nothing is compared with all triangles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators.mesh import _abc, corners_of
from isovane.operators.stencil import KEY
from isovane.plans.lineage import cut
from isovane.sources.voxels import Grid

BRICK = 8
KEY_OF_A = ("ax", "ay", "az")
#: (triangle, brick) pairs that are worked out together.
BATCH = 128
#: Cells that a ray crosses in a round, times the size of a cell.
REACH = 32
TOUCH = 1e-9


def _box(wide: float) -> list[tuple[Column, Column]]:
    """(low, high) of a triangle's box along each axis, widened."""
    return [(F.least(*[F.col(f"{n}{k}") for n in "abc"]) - wide, F.greatest(*[F.col(f"{n}{k}") for n in "abc"]) + wide) for k in KEY]


def _distance2(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(row, place): squared distances of places (row, place, 3) to each row's triangle: the face where the foot lies in it, else the nearest side."""
    dot = lambda u, v: (u * v).sum(-1)

    def segment(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        side, rel = (v - u)[:, None], p - u[:, None]
        size = dot(side, side)
        t = np.where(size > g.TINY, np.clip(dot(rel, side) / np.where(size > g.TINY, size, 1.0), 0, 1), 0.0)
        gap = rel - t[..., None] * side
        return dot(gap, gap)

    n = np.cross(b - a, c - a)
    area2 = dot(n, n)[:, None]
    inside = area2 > g.TINY
    for u, v in ((a, b), (b, c), (c, a)):
        inside = inside & (dot(p - u[:, None], np.cross(n, v - u)[:, None]) >= 0)
    height = dot(p - a[:, None], n[:, None])
    return np.where(inside, height * height / np.where(area2 > g.TINY, area2, 1.0), np.minimum(np.minimum(segment(a, b), segment(b, c)), segment(c, a)))


def mask(triangles: DataFrame, vertices: DataFrame, grid: Grid, half_width: float) -> DataFrame:
    """(x, y, z): voxels less than ``half_width`` voxels away from a mesh, each once.

    Distances are exact, from the place of a voxel to the triangle, measured in voxels. Triangles go to the bricks that their
    widened boxes touch; those too far away to hold a voxel of the band are passed over, so a long triangle makes rows
    for its band, not for its box. Batches of (triangle, brick) need no grouping: however many triangles meet in one brick, they
    are spread over tasks, and only voxels are made distinct. No mesh, no rows. The half width must be finite and positive.
    """
    if not math.isfinite(half_width) or half_width <= 0:
        raise ValueError("the half width of a mask must be finite and positive")
    at = g.to_index(grid, F.col("px"), F.col("py"), F.col("pz"))
    placed = vertices.select("vid", *[c.alias(p) for c, p in zip(at, ("px", "py", "pz"), strict=True)])
    bricks = corners_of(triangles.select("tid", "a", "b", "c"), placed)
    for k, (low, high) in zip(KEY, _box(half_width), strict=True):
        bricks = bricks.withColumn(f"b{k}_", F.explode(F.sequence(F.floor(low / BRICK), F.floor(high / BRICK))))
    inner = np.stack(np.meshgrid(*[np.arange(BRICK)] * 3, indexing="ij"), -1).reshape(1, -1, 3)
    middle, reach = (BRICK - 1) / 2, half_width + math.sqrt(3) * (BRICK - 1) / 2 + TOUCH

    def band(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), BATCH):
                part = frame.iloc[start : start + BATCH]
                a, b, c = (part[[f"{n}{k}" for k in KEY]].to_numpy(float) for n in "abc")
                low = part[[f"b{k}_" for k in KEY]].to_numpy(np.int64) * BRICK
                near = _distance2((low + middle)[:, None], a, b, c)[:, 0] <= reach * reach
                places = low[near][:, None] + inner
                held = places[np.round(_distance2(places.astype(float), a[near], b[near], c[near]), 9) < half_width * half_width]
                yield pd.DataFrame(np.unique(held, axis=0), columns=KEY)

    corners = [f"{n}{k}" for n in "abc" for k in KEY]
    parts = int(bricks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bricks.select(*corners, *[f"b{k}_" for k in KEY]).repartition(parts, *KEY_OF_A, *[f"b{k}_" for k in KEY])  # few bytes, much work
    return dealt.mapInPandas(band, "x int, y int, z int").distinct()


def _binned(full: DataFrame, cell: float) -> DataFrame:
    """Triangles once for each cell that their boxes touch."""
    for k, (low, high) in zip(KEY, _box(TOUCH * cell), strict=True):
        full = full.withColumn(f"q{k}", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    return full


def _crossed(low: Column, high: Column, cell: float) -> Column:
    """Distances in the middle of each cell on the way of a ray between two distances, in order."""
    marks = [F.array(low), F.array(high)]
    for k in KEY:
        o, d = F.col(f"o{k}"), F.col(f"d{k}")
        ends = (o + d * low) / cell, (o + d * high) / cell
        walls = F.sequence(F.ceil(F.least(*ends)), F.floor(F.greatest(*ends)))
        inside = (F.abs(d) > g.TINY) & (F.ceil(F.least(*ends)) <= F.floor(F.greatest(*ends)))
        marks.append(_walls(walls, inside, o, d, cell))
    way = F.array_sort(F.array_distinct(F.filter(F.concat(*marks), lambda t: (t >= low) & (t <= high))))
    return F.transform(F.slice(way, F.lit(1), F.greatest(F.size(way) - 1, F.lit(1))), lambda t, i: (t + F.coalesce(F.get(way, i + 1), t)) / 2)


def _walls(walls: Column, inside: Column, o: Column, d: Column, cell: float) -> Column:
    """Distances at which a ray passes the walls between cells along one axis."""
    return F.when(inside, F.transform(walls, lambda i: (i * cell - o) / d)).otherwise(F.array().cast("array<double>"))


def ray_hits(rays: DataFrame, triangles: DataFrame, vertices: DataFrame, cell: float) -> DataFrame:
    """(rid, slot, tid, distance, u, v, px, py, pz): the first triangle that each ray meets; rays that meet none give no row.

    rays: rid, ox, oy, oz, dx, dy, dz and, if it is there, ``slots`` (array<int>: the meshes a ray sees, null: all). triangles: tid, a, b,
    c and ``slot`` (0 where missing). Directions need no unit length; rays without a finite direction meet nothing. Equal
    distances (to nine places): the smaller slot, then tid. Rows that share a rid are one ray with several ways.

    Rays that have met nothing go on, ``REACH`` cells in a round, until they leave the box of the mesh; a hit counts in
    the round whose stretch it lies in, so that what a ray has met is the first there is.
    """
    if not math.isfinite(cell) or cell <= 0:
        raise ValueError("cells need a finite, positive size")
    sides = triangles.select("tid", "a", "b", "c", (F.col("slot") if "slot" in triangles.columns else F.lit(0)).cast("int").alias("slot"))
    full = corners_of(sides, vertices).drop("a", "b", "c")
    ends = full.agg(*[F.min(low).alias(f"l{k}") for k, (low, _) in zip(KEY, _box(0.0), strict=True)], *[F.max(high).alias(f"h{k}") for k, (_, high) in zip(KEY, _box(0.0), strict=True)]).first()
    found = rays.sparkSession.createDataFrame([], "rid long, slot int, tid long, distance double, u double, v double, px double, py double, pz double")
    if ends.lx is None:
        return found
    binned = cut(_binned(full, cell))
    slots = F.col("slots") if "slots" in rays.columns else F.lit(None).cast("array<int>")
    size = g.length(g.vector("dx", "dy", "dz"))
    unit = rays.where((size > g.TINY) & (size < float("inf"))).select("rid", *[F.col(f"o{k}").cast("double").alias(f"o{k}") for k in KEY], *[(F.col(f"d{k}") / size).alias(f"d{k}") for k in KEY], slots.alias("slots"))
    near, far = F.lit(0.0), F.lit(float("inf"))
    for k in KEY:
        o, d = F.col(f"o{k}"), F.col(f"d{k}")
        low, high = F.lit(ends[f"l{k}"] - TOUCH), F.lit(ends[f"h{k}"] + TOUCH)
        flat, one, two = F.abs(d) <= g.TINY, (low - o) / d, (high - o) / d
        near = F.when(flat, F.when((o < low) | (o > high), float("inf")).otherwise(near)).otherwise(F.greatest(near, F.least(one, two)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(one, two)))
    open_ = cut(unit.select("*", near.alias("at"), far.alias("end")).where(F.col("at") <= F.col("end")))
    while not open_.isEmpty():
        stop = F.least(F.col("at") + REACH * cell, F.col("end"))
        steps = open_.withColumn("stop", stop).withColumn("mid", F.explode(_crossed(F.col("at"), F.col("stop"), cell)))
        cells = steps.select("*", *[F.floor((F.col(f"o{k}") + F.col(f"d{k}") * F.col("mid")) / cell).alias(f"q{k}") for k in KEY]).drop("mid").distinct()
        met = cells.join(binned, [f"q{k}" for k in KEY]).where(F.col("slots").isNull() | F.array_contains("slots", F.col("slot")))
        t, u, v = g.hit_triangle(g.vector("ox", "oy", "oz"), g.vector("dx", "dy", "dz"), *_abc())
        hits = met.select("rid", "slot", "tid", t.alias("distance"), u.alias("u"), v.alias("v"), "at", "stop", *[(F.col(f"o{k}") + F.col(f"d{k}") * t).alias(f"p{k}") for k in KEY])
        stretch = hits.where((F.col("distance") >= F.col("at") - TOUCH) & (F.col("distance") <= F.col("stop") + TOUCH))
        first = stretch.groupBy("rid").agg(F.min(F.struct(F.round("distance", 9).alias("r"), "slot", "tid", "distance", "u", "v", "px", "py", "pz")).alias("h"))
        fresh = cut(first.select("rid", *[F.col(f"h.{c}").alias(c) for c in ("slot", "tid", "distance", "u", "v", "px", "py", "pz")]))
        found = found.unionByName(fresh)
        left = open_.join(fresh.select("rid"), "rid", "left_anti").withColumn("at", stop)
        open_ = cut(left.where(F.col("at") < F.col("end")))
    return found
