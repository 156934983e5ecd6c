"""Mesh masks and tables of rays against all triangles, in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from isovane.operators import meshspace
from isovane.sources import voxels


def ball(radius: float, rings: int = 9, sides: int = 14, centre=(0.0, 0.0, 0.0)):
    """Corners of the triangles of a closed ball."""
    def at(i, j):
        a, b = math.pi * i / rings, 2 * math.pi * j / sides
        return tuple(c + radius * v for c, v in zip(centre, (math.sin(a) * math.cos(b), math.sin(a) * math.sin(b), math.cos(a)), strict=True))

    out = []
    for i in range(rings):
        for j in range(sides):
            p, q, r, s = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            out += [(p, q, r)] * (i < rings - 1) + [(p, r, s)] * (i > 0)
    return np.array(out)


def tables(spark, corners, slots=None):
    n = len(corners)
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(corners.reshape(-1, 3))], "vid long, px double, py double, pz double")
    triangles = spark.createDataFrame([(i, 3 * i, 3 * i + 1, 3 * i + 2, int(slots[i]) if slots is not None else 0) for i in range(n)], "tid long, a long, b long, c long, slot int")
    return triangles, vertices


def grid(spark, spacing=(1.0, 1.0, 1.0)):
    return voxels.Grid(spark.createDataFrame([], "x int, y int, z int, value double, active boolean"), voxels.FOG, 0.0, spacing)


def distance2(p, a, b, c):
    """Squared distances of places to one triangle: the plane's foot where it lies inside, else the nearest side."""
    def side(u, v):
        d = v - u
        t = np.clip((p - u) @ d / (d @ d), 0, 1)
        return ((p - u - t[:, None] * d) ** 2).sum(1)

    n = np.cross(b - a, c - a)
    inside = np.all([np.cross(v - u, p - u) @ n >= 0 for u, v in ((a, b), (b, c), (c, a))], 0)
    return np.where(inside, ((p - a) @ n) ** 2 / (n @ n), np.minimum(np.minimum(side(a, b), side(b, c)), side(c, a)))


@pytest.mark.parametrize("half", [1.0, 2.0, 3.0])
def test_masks_of_a_ball_and_a_long_sliver(spark, half):
    spacing = (0.5, 0.5, 1.0)
    corners = np.concatenate([ball(3.1), [[(-9.0, -8.0, -7.0), (9.0, 9.5, 8.0), (9.0, 9.5, 8.4)]]])
    got = {tuple(r) for r in meshspace.mask(*tables(spark, corners), grid(spark, spacing), half).collect()}
    places = np.stack(np.meshgrid(*[np.arange(-24, 25)] * 3, indexing="ij"), -1).reshape(-1, 3)
    near = np.zeros(len(places), bool)
    for a, b, c in corners / np.array(spacing):
        near |= np.round(distance2(places.astype(float), a, b, c), 9) < half * half
    assert got == {tuple(p) for p in places[near].tolist()} and len(got) > 500


def test_masks_need_a_width_and_may_be_empty(spark):
    triangles, vertices = tables(spark, ball(1.0))
    for bad in (0.0, -1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            meshspace.mask(triangles, vertices, grid(spark), bad)
    assert meshspace.mask(triangles.where("false"), vertices, grid(spark), 2.0).count() == 0
    flat = np.array([[(0.2, 0.0, 0.0), (0.2, 0.0, 0.0), (0.2, 0.0, 0.0)]])
    assert {tuple(r) for r in meshspace.mask(*tables(spark, flat), grid(spark), 1.0).collect()} == {(0, 0, 0), (1, 0, 0)}


def first_hits(rays, corners, slots):
    """rid -> (slot, tid, distance) by trying every triangle."""
    out, (a, b, c) = {}, corners.transpose(1, 0, 2)
    for rid, o, d, seen in rays:
        size = np.linalg.norm(d)
        if not 0 < size < math.inf:
            continue
        d = np.array(d) / size
        with np.errstate(all="ignore"):
            h = np.cross(d, c - a)
            det = ((b - a) * h).sum(1)
            s = np.array(o) - a
            u, q = (s * h).sum(1) / det, np.cross(s, b - a)
            v, t = q @ d / det, (q * (c - a)).sum(1) / det
            hit = (np.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (np.isin(slots, seen) if seen is not None else True)
        if hit.any():
            i = min(np.flatnonzero(hit), key=lambda k: (round(float(t[k]), 9), slots[k], k))
            out[rid] = (int(slots[i]), int(i), float(t[i]))
    return out


@pytest.mark.parametrize("cell,reach", [(0.7, 32), (0.4, 3)])
def test_a_table_of_rays(spark, monkeypatch, cell, reach):
    monkeypatch.setattr(meshspace, "REACH", reach)
    rng = np.random.default_rng(3)
    corners = np.concatenate([ball(2.0), ball(1.0, 6, 8, (4.0, 0.5, 0.0)), [[(-6.0, -6.0, -3.0), (7.0, -6.0, -3.0), (0.0, 9.0, -3.0)]]])
    slots = np.array([0] * len(ball(2.0)) + [1] * len(ball(1.0, 6, 8)) + [2])
    seen = [None, [0], [1, 2], [], [0, 1, 2]]
    rays = [(i, rng.uniform(-8, 8, 3).tolist(), rng.normal(size=3).tolist(), seen[i % 5]) for i in range(2_000)]
    rays += [(5_000, [-7.0, 0.1, 0.2], [2.0, 0.0, 0.0], None), (5_001, [0.0, 0.0, 9.0], [0.0, 0.0, -1e-3], None), (5_002, [0.1, 0.0, 0.0], [0.0, 0.0, 0.0], None), (5_003, [0.1, 0.0, 0.0], [math.inf, 0.0, 0.0], None), (5_004, [0.1, 0.1, -2.9], [0.0, 0.0, -1.0], [2])]
    table = spark.createDataFrame([(i, *o, *d, s) for i, o, d, s in rays], "rid long, ox double, oy double, oz double, dx double, dy double, dz double, slots array<int>")
    want = first_hits(rays, corners, slots)
    got = {r.rid: (r.slot, r.tid, r.distance) for r in meshspace.ray_hits(table, *tables(spark, corners, slots), cell).collect()}
    assert set(got) == set(want) and len(want) > 100
    assert all(got[i][0] == want[i][0] and abs(got[i][2] - want[i][2]) < 1e-9 for i in want)
    assert sum(got[i][1] != want[i][1] for i in want) == 0


def test_no_triangles_and_no_rays(spark):
    triangles, vertices = tables(spark, ball(1.0))
    one = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0, 0.0, -1.0)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert meshspace.ray_hits(one, triangles.where("false"), vertices, 1.0).count() == 0
    assert meshspace.ray_hits(one.where("false"), triangles, vertices, 1.0).count() == 0
    assert meshspace.ray_hits(one, triangles.drop("slot"), vertices, 1.0).first().slot == 0
    with pytest.raises(ValueError):
        meshspace.ray_hits(one, triangles, vertices, 0.0)
