"""Queries that ask for every row, against brute force."""

from __future__ import annotations

import pytest

from isovane import queries
from isovane.operators import target
from isovane.queries import fields, meshes
from isovane.sources import voxels as v

SF = "/root/testdata/sf0.001"


def test_radius_join_of_every_point(spark):
    points = [(r.vec_id, *map(float, r.embedding[:3])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {(a[0], b[0]) for a in points for b in points if sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) <= fields.RADIUS**2}
    got = [(r.pid, r.p_pid) for r in queries.queries()["c12_radius_join_all"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {a for a, _ in got} == {p[0] for p in points}


def test_nearest_sample_in_the_whole_box(spark):
    spacing, shift = (0.31, 0.31, 1.0), (0.01, 0.02, 0.03)
    inside = {(0, 0, 0), (3, 1, 6), (6, 2, 1)}
    places = [(x, y, z) for x in range(8) for y in range(3) for z in range(12)]
    grid = v.from_rows(spark, [(*p, 255.0 if p in inside else 1.0) for p in places], spacing=spacing)
    core = target.core_voxels(grid, 128.0)
    assert {(r.x, r.y, r.z) for r in core.collect()} == inside
    want = {}
    for p in places:
        near = [(sum((a * s + o - b * s) ** 2 for a, b, s, o in zip(p, c, spacing, shift, strict=True)), c) for c in inside if all(abs(a - b) <= 4 for a, b in zip(p, c, strict=True))]
        if near:
            want[p] = min(near)
    rows = fields.nearest_in_box(grid, core, shift).collect()
    assert {(r.x, r.y, r.z): (r.core_x, r.core_y, r.core_z) for r in rows} == {p: c for p, (_, c) in want.items()}
    assert all(r.d2 == pytest.approx(want[r.x, r.y, r.z][0]) for r in rows) and len(rows) == len(want)
    assert any(abs(z - c[2]) == 4 for (_, _, z), (_, c) in want.items())


def test_heat_reaches_every_vertex(spark):
    _, _, vs, _ = meshes._mesh(spark, SF)
    rows = queries.queries()["c19_d27_b27_heatmap"](spark, SF).collect()
    assert sum(r.n for r in rows) == vs.count()


def test_zip_refuses_what_does_not_match(spark):
    a = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0)], "x int, y int, z int, value double")
    b = spark.createDataFrame([(0, 0, 0, 3.0), (1, 0, 0, 4.0)], "x int, y int, z int, other double")
    assert {(r.value, r.other) for r in target.zipped(a, b).collect()} == {(1.0, 3.0), (2.0, 4.0)}
    for wrong in (b.where("x = 0"), b.unionByName(b)):
        with pytest.raises(ValueError):
            target.zipped(a, wrong)
