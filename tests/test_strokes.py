"""Whole brush strokes on a plane of fog: distances, gaps, centrelines, clipping, and a plain shortest path beside them."""

from __future__ import annotations

import heapq
import math

import pytest

from isovane.operators import paths, tiles
from isovane.sources import voxels as v

SPACING = (0.31, 0.31, 1.0)


def plane(spark, gap: bool) -> v.Grid:
    rows = [(x, y, z, 1.0) for z in range(-5, 6) for y in range(-10, 11) if not (gap and y == 0) for x in range(-4, 1)]
    return v.from_rows(spark, rows, spacing=SPACING)


def run(spark, grid, points, **kw):
    path = spark.createDataFrame([(i, *(c * s for c, s in zip(p, SPACING, strict=True))) for i, p in enumerate(points)], "seq int, wx double, wy double, wz double")
    samples, line = paths.stroke(grid, path, paths.BrushSettings(**({"iso": 0.5, "planarity_radius": 1.5, "search": 1.1} | kw)))
    return {(r.x, r.y, r.z): r for r in samples.collect()}, [(r.piece, (r.x, r.y, r.z)) for r in line.orderBy("piece", "seq").collect()]


def test_distance_is_in_world_units(spark):
    found, line = run(spark, plane(spark, False), [(0, 0, 0)], core=0.4, width=2.0, strength=2.5)
    seed, beside, above = found[0, 0, 0], found[0, 1, 0], found[0, 0, 1]
    assert line == [(1, (0, 0, 0))] and seed.weight == 2.5
    assert beside.dist == pytest.approx(0.31, abs=1e-4) and above.dist == pytest.approx(1.0, abs=1e-4)
    assert beside.planarity > 0.9 and beside.nx > 0.99 and beside.weight > above.weight
    assert all(0 <= r.weight <= 2.5 and 0 <= r.planarity <= 1 and r.dist < 2.4 for r in found.values())

    # The same by a plain queue over the same costs.
    grid = plane(spark, False)
    links = {}
    for r in paths.cost_graph(tiles.skin(grid, 0.5, 1.5, math.radians(15)), SPACING).collect():
        links.setdefault(r.u, []).append((r.v, r.cost))
    key = lambda x, y, z: ((x + (1 << 20)) << 42) + ((y + (1 << 20)) << 21) + z + (1 << 20)
    best, queue = {}, [(0.0, key(0, 0, 0))]
    while queue:
        d, node = heapq.heappop(queue)
        if node not in best and d < 2.4:
            best[node] = d
            for there, cost in links[node]:
                heapq.heappush(queue, (d + cost, there))
    assert {key(*k): pytest.approx(r.dist) for k, r in found.items()} == best


def test_a_gap_stops_the_brush(spark):
    found, line = run(spark, plane(spark, True), [(0, -1, 0), (0, 1, 0)][:1], core=0.2, width=2.8)
    assert (0, -1, 0) in found and (0, 1, 0) not in found
    _, line = run(spark, plane(spark, True), [(0, -4, 0), (0, -2, 0), (0, 4, 0)], core=0.2, width=0.5, search=0.2)
    assert [p for p, _ in line] == [1, 1, 1, 2] and line[-1] == (2, (0, 4, 0))


def test_every_point_of_a_stroke_counts(spark):
    found, line = run(spark, plane(spark, False), [(0, -5, 0), (0, -5, 0), (0, 5, 0)], core=0.4, width=0.3)
    assert found[0, -5, 0].weight == found[0, 5, 0].weight == 1.0
    assert {p for p, _ in line} == {1} and line[0][1] == (0, -5, 0) and line[-1][1] == (0, 5, 0)
    steps = [max(abs(a - b) for a, b in zip(p, q, strict=True)) for (_, p), (_, q) in zip(line, line[1:], strict=False)]
    assert steps == [1] * 10


def test_points_off_the_surface_give_nothing(spark):
    assert run(spark, plane(spark, False), [(60, 0, 0)], core=0.4, width=0.3) == ({}, [])
    with pytest.raises(ValueError):
        paths.BrushSettings(0.0, 0.0)


def test_spacing_of_one_long_stroke_without_id(spark):
    from pyspark.sql import functions as F

    from isovane.operators import strokes

    line = spark.range(30_000).select(F.lit(None).cast("long").alias("stroke_id"), F.col("id").alias("seq"), (F.col("id") / 10.0).alias("wx"), F.lit(0.0).alias("wy"), F.when(F.col("id") % 7 != 3, 0.0).alias("wz"))
    kept = [r.seq for r in strokes.spaced(line, 1.0).orderBy("seq").collect()]
    want, last = [], None
    for i in range(30_000):
        if last is None or (i % 7 != 3 and (i / 10.0 - last) ** 2 >= 1.0):
            want, last = [*want, i], i / 10.0
    assert kept == want and strokes.spaced(line.where("seq < 0"), 1.0).count() == 0


def test_mean_planarity_of_what_is_painted(spark):
    painted = spark.createDataFrame([(0.5,), (1.0,), (0.0,), (None,)], "planarity float")
    assert tuple(paths.mean_planarity(painted).first()) == (4, 0.5)
    assert tuple(paths.mean_planarity(painted.where("false")).first()) == (0, 0.0)
