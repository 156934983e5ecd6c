"""Tables of capsules against every leaf, with the distance found by narrowing down along each segment."""

from __future__ import annotations

import math
import random

import pytest

from isovane.operators import recon
from isovane.sources import voxels

NAMES = "sid long, ax double, ay double, az double, bx double, by double, bz double, radius double"
SPACING = (0.3, 0.3, 1.0)


def grid(spark):
    return voxels.Grid(spark.createDataFrame([], "x int, y int, z int, value double, active boolean"), voxels.FOG, 0.0, SPACING, (1.0, -2.0, 0.5))


def distance2(row, leaf):
    """The distance along a segment is convex: thirds narrow its least value down."""
    a, b = row[1:4], row[4:7]
    low = [o + 8 * s * k for o, s, k in zip((1.0, -2.0, 0.5), SPACING, leaf, strict=True)]

    def at(t):
        return sum(max(x - (p + (q - p) * t), (p + (q - p) * t) - x - 7 * s, 0) ** 2 for p, q, x, s in zip(a, b, low, SPACING, strict=True))

    u, v = 0.0, 1.0
    for _ in range(120):
        m, n = u + (v - u) / 3, v - (v - u) / 3
        u, v = (u, n) if at(m) <= at(n) else (m, v)
    return min(at(0.0), at(1.0), at((u + v) / 2))


def test_paths_of_all_sizes(spark):
    rng = random.Random(6)
    leaves = sorted({(rng.randrange(-6, 6), rng.randrange(-6, 6), rng.randrange(-3, 3)) for _ in range(250)})
    place = lambda r: [rng.uniform(-r, r) for _ in range(3)]
    rows = [(i % 9, *place(15), *place(15), rng.choice([0.0, 0.1, 1.0, 4.0])) for i in range(30)]
    rows += [(20, *p, *p, 3.0) for p in (place(10), place(10))] + [(21, -400.0, -390.0, -300.0, 410.0, 420.0, 310.0, 0.5), (22, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 500.0), (23, 900.0, 0.0, 0.0, 950.0, 0.0, 0.0, 2.0)]
    table = spark.createDataFrame(rows, NAMES).selectExpr("*", "1 AS level", "2 AS n", "3 AS bi")
    got = {(r.sid, r.bi, r.bj, r.bk): r.d2 for r in recon.capsule_table(spark.createDataFrame(leaves, "bi int, bj int, bk int"), grid(spark), table).collect()}
    want, edge = {}, set()
    for row in rows:
        for leaf in leaves:
            d = distance2(row, leaf)
            if abs(d - row[7] ** 2) < 1e-9:
                edge.add((row[0], *leaf))  # on the border to the last digits
            if d <= row[7] ** 2:
                want[row[0], *leaf] = min(d, want.get((row[0], *leaf), math.inf))
    assert set(got) - edge == set(want) - edge and len(want) > 300 and {k[0] for k in want} >= {21, 22} and 23 not in {k[0] for k in want}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in set(want) - edge)


def test_rows_that_are_no_capsules_and_the_limit(spark):
    leaves = spark.createDataFrame([(i, 0, 0) for i in range(10)], "bi int, bj int, bk int")
    bad = [(1, 0.0, 0.0, 0.0, None, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0, math.nan, 0.0, 0.0, 1.0), (1, math.inf, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)]
    assert recon.capsule_table(leaves, grid(spark), spark.createDataFrame(bad, NAMES)).count() == 0
    long = spark.createDataFrame([(5, 1.0, -2.0, 0.5, 30.0, -2.0, 0.5, 0.5), (5, 1.0, -2.0, 0.5, 30.0, -2.0, 0.5, 0.5), (None, 1.0, -2.0, 0.5, 1.0, -2.0, 0.5, 0.1)], NAMES)
    found = recon.capsule_table(leaves, grid(spark), long, most=10)
    assert sorted((r.sid is None, r.bi) for r in found.collect()) == [(False, i) for i in range(10)] + [(True, 0)]
    with pytest.raises(ValueError):
        recon.capsule_table(leaves, grid(spark), long, most=9)
    assert recon.capsule_table(leaves.where("false"), grid(spark), long).count() == 0
