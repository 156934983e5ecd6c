"""Small grids with known answers."""

from __future__ import annotations

import io
import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.functions import linalg
from isovane.operators import bricks, clouds, mesh, normals, paths, slices, strokes, target, tiles
from isovane.operators.stencil import box, diamond, half_box, radius_join
from isovane.sources import stores
from isovane.sources import voxels as v

SPACING = (0.31, 0.31, 1.0)


def layered(spark, side: int, depth: int) -> v.Grid:
    rows = [(x, y, z, 255.0 if x <= 0 else {1: 128.0, 2: 64.0}[x]) for y in range(-side, side + 1) for z in range(-side, side + 1) for x in range(-depth, 3)]
    return v.from_rows(spark, rows, spacing=SPACING)


def rows_of(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_offsets():
    assert len(box(1)) == 26 and len(half_box()) == 13 and len(diamond(2)) == 24
    assert {tuple(-c for c in o) for o in half_box()} | set(half_box()) == set(box(1))


def test_layered_grid(spark):
    grid = layered(spark, 2, 2)
    rows = {(r.x, r.y, r.z): r for r in target.extract(grid, target.TargetSettings()).collect()}
    kinds = [r.kind for r in rows.values()]
    assert (kinds.count("core"), kinds.count("transition")) == (66, 50)
    assert rows[0, 0, 0].kind == "core" and rows[0, 0, 0].nx > 0.9
    assert (rows[1, 0, 0].layer, rows[2, 0, 0].layer) == (1, 2)
    assert rows[1, 0, 0].support == pytest.approx(0.3346, abs=1e-4) and rows[2, 0, 0].support == pytest.approx(0.0837, abs=1e-4)
    again = target.extract(grid, target.TargetSettings())
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.values()}


def test_results_do_not_depend_on_partitions_or_place(spark):
    grid = layered(spark, 2, 2)
    base = rows_of(target.classified(grid, target.TargetSettings()), "x", "y", "z", "kind", "layer")
    many = grid.of(grid.voxels.repartition(13))
    assert rows_of(target.classified(many, target.TargetSettings()), "x", "y", "z", "kind", "layer") == base
    moved = grid.of(grid.voxels.withColumn("x", F.col("x") - 9).withColumn("z", F.col("z") + 5))
    assert {(x + 9, y, z - 5, k, n) for x, y, z, k, n in rows_of(target.classified(moved, target.TargetSettings()), "x", "y", "z", "kind", "layer")} == base


def test_settings_and_classes_are_checked(spark):
    with pytest.raises(ValueError):
        target.TargetSettings(layers=0)
    with pytest.raises(ValueError):
        v.from_rows(spark, [(0, 0, 0, 1.0)], grid_class="unknown")
    with pytest.raises(ValueError):
        bricks.from_grid(v.from_rows(spark, [(0, 0, 0, 1.0)], grid_class=v.LEVEL_SET))


def test_bricks(spark):
    grid = v.from_rows(spark, [(-8, 0, 0, 1.25), (-1, 7, 7, 2.5), (0, 0, 0, 3.75), (7, 7, 7, 5.0), (0, 8, 8, 6.25)], spacing=SPACING)
    packed = bricks.from_grid(grid).cache()
    assert sorted((r.bi, r.bj, r.bk, r.active_count) for r in packed.collect()) == [(-1, 0, 0, 2), (0, 0, 0, 2), (0, 1, 1, 1)]
    around = {(r.bi, r.bj, r.bk, r.slot): r.neighbour for r in bricks.neighbour_table(packed).collect()}
    at = lambda *b: spark.range(1).select(target.pack_key(*[F.lit(c) for c in b])).first()[0]
    assert around[-1, 0, 0, bricks.slot_of(1, 0, 0)] == at(0, 0, 0)
    assert around[0, 0, 0, bricks.slot_of(0, 1, 1)] == at(0, 1, 1)
    assert around[0, 0, 0, bricks.slot_of(1, 0, 0)] == bricks.NONE
    report = bricks.validate(grid.voxels, bricks.to_voxels(packed)).first()
    assert tuple(report) == (0, 0, 0, 0, 0.0)
    with pytest.raises(ValueError):
        bricks.slot_of(0, 0, 0)


def test_slice(spark):
    grid = v.from_rows(spark, [(x, y, 2, float(x + y)) for x in range(5) for y in range(4)], spacing=(0.25, 0.5, 1.0))
    pixels, width, height = slices.extract(grid, "z", 2)
    values = {(r.row, r.col): r.value for r in pixels.collect()}
    assert (width, height, values[3, 4]) == (5, 4, 7.0)
    for level in (2.0, 4.0):
        assert slices.contours(pixels, level, width, height).count() > 0


def test_components(spark):
    samples = spark.createDataFrame([(0, 0, 0, "core", 0), (1, 0, 0, "core", 0), (10, 0, 0, "core", 0), (11, 0, 0, "transition", 1), (2, 0, 0, "transition", 1)], "x int, y int, z int, kind string, layer int")
    assert target.components(samples.where("kind = 'core'")).select("component").distinct().count() == 2
    assert rows_of(target.split_primary(samples).where("primary"), "x") == {(0,), (1,), (2,)}
    assert target.split_primary(samples.where("kind = 'transition'")).where("primary").count() == 2


def sphere(spark, fog: bool) -> v.Grid:
    r, n = 5.3, 9  # no voxel lies on the surface itself
    rows = []
    for x in range(-n, n + 1):
        for y in range(-n, n + 1):
            for z in range(-n, n + 1):
                d = math.sqrt(x * x + y * y + z * z) - r
                if abs(d) < 3:
                    rows.append((x, y, z, min(1.0, max(0.0, (3 - d) / 6)) if fog else d))
                elif d < 0:
                    rows.append((x, y, z, 1.0 if fog else -3.0))
    return v.from_rows(spark, rows, grid_class=v.FOG if fog else v.LEVEL_SET, background=0.0 if fog else 3.0)


@pytest.mark.parametrize("fog", [True, False])
def test_sphere_mesh_points_outward(spark, fog):
    grid = sphere(spark, fog)
    iso = 0.5 if fog else 0.0
    vertices, triangles = (t.cache() for t in mesh.surface_net(grid, iso))
    counts = mesh.edge_counts(triangles).first()
    assert (counts.boundary, counts.non_manifold) == (0, 0)
    for r in mesh.vertex_normals(triangles, vertices).collect():
        assert r.px * r.nx + r.py * r.ny + r.pz * r.nz > 4 and abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-9
        assert abs(math.sqrt(r.px**2 + r.py**2 + r.pz**2) - 5.3) < 0.5
    n_v, n_t = vertices.count(), triangles.count()
    assert n_v - counts.edges + n_t == 2  # one closed surface
    hit = mesh.ray_hit(triangles, vertices, (20.0, 0.2, 0.3), (-1.0, 0.0, 0.0)).first()
    assert abs(hit.distance - 14.7) < 0.3
    evidence = mesh.winding_evidence(grid, triangles, vertices).first().evidence
    assert evidence < 0 if fog else evidence > 0
    target_rows = tiles.surface(grid, target.TargetSettings(iso=iso, planarity_radius=2.0)).where("kind = 'core'").collect()
    assert all(r.x * r.nx + r.y * r.ny + r.z * r.nz > 0 for r in target_rows)


def test_glb(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "vid long, px double, py double, pz double, nx double, ny double, nz double")
    triangles = spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long")
    for with_normals in (True, False):
        out = io.BytesIO()
        size = mesh.write_glb(out, vertices, triangles, with_normals)
        raw = out.getvalue()
        assert raw[:4] == b"glTF" and len(raw) == size == struct.unpack("<I", raw[8:12])[0]
        document = json.loads(raw[20 : 20 + struct.unpack("<I", raw[12:16])[0]])
        assert ("NORMAL" in document["meshes"][0]["primitives"][0]["attributes"]) == with_normals
        assert document["accessors"][-1]["componentType"] == 5125 and struct.unpack("<3I", raw[-12:]) == (0, 1, 2)


def test_two_triangles_apart(spark):
    vertices = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (10, 0), (13, 0), (10, 1), (5, 5)])], "vid long, px double, py double, pz double")
    triangles = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "tid long, a long, b long, c long")
    sizes = mesh.component_sizes(triangles, vertices).collect()
    assert sorted((r.n, r.area, r.primary) for r in sizes) == [(1, 0.5, False), (1, 1.5, True)]
    kept, out = mesh.compact(mesh.split(triangles, vertices).where("primary").drop("primary"), vertices)
    assert [tuple(r) for r in out.select("a", "b", "c").collect()] == [(0, 1, 2)] and rows_of(kept, "vid", "px") == {(0, 10.0), (1, 13.0), (2, 10.0)}
    points = spark.createDataFrame([(0, 0.2, 0.2, 0.5), (1, 50.0, 0.0, 0.0)], "pid long, wx double, wy double, wz double")
    assert [(r.pid, r.tid, round(r.d2, 6)) for r in mesh.nearest_triangles(points, triangles, vertices, 1.0).collect()] == [(0, 0, 0.25)]


def sheet(spark, n: int, m: int, turned=lambda i, j: False):
    rows = [(i, j, 0, "core", float(i), float(j), 0.0, 1.0, 0.0, 0.0, -1.0 if turned(i, j) else 1.0) for i in range(n) for j in range(m)]
    return spark.createDataFrame(rows, "x int, y int, z int, kind string, wx double, wy double, wz double, support double, nx double, ny double, nz double")


def test_flip_patch(spark):
    field = sheet(spark, 11, 11, lambda i, j: 4 <= i <= 6 and 4 <= j <= 6)
    preview = normals.flip_preview(field, (5, 5, 0))
    assert preview.where("role = 'affected'").count() == 9
    assert {r.reason for r in normals.boundary_reasons(preview).collect()} == {"aligned"}
    assert normals.apply_flip(field, preview).where("nz < 0.99").count() == 0


def test_flip_chain_cap_and_direction(spark):
    field = sheet(spark, 7, 1, lambda i, j: 2 <= i <= 4)
    key = {i: spark.range(1).select(target.pack_key(F.lit(i), F.lit(0), F.lit(0))).first()[0] for i in range(7)}
    preview = {r.node: r for r in normals.flip_preview(field, (3, 0, 0)).where("role = 'affected'").collect()}
    assert set(preview) == {key[2], key[3], key[4]} and preview[key[2]].parent == key[3]
    capped = normals.flip_preview(field, (3, 0, 0), cap=2)
    assert capped.where("role = 'capped'").count() >= 2 and normals.apply_flip(field, capped).exceptAll(field).isEmpty()
    trace = spark.createDataFrame([(key[3], key[2]), (key[4], key[3])], "node long, parent long")
    assert {r.node for r in normals.flip_preview(field, (3, 0, 0), trace=trace).where("role = 'affected'").collect()} == {key[3], key[4]}


def test_fit_smooth_and_orient(spark):
    field = sheet(spark, 8, 8)
    fitted = normals.fit(field, "5x5").cache()
    assert all(abs(abs(r.nz) - 1) < 1e-9 for r in fitted.collect())
    assert normals.smooth(fitted, None) is fitted
    assert all(abs(abs(r.nz) - 1) < 1e-9 for r in normals.smooth(fitted, "3x3").collect())
    mixed = sheet(spark, 8, 8, lambda i, j: (i * 7 + j) % 3 == 0)
    outer = spark.createDataFrame([(i, 3, k, "transition", float(i), 3.0, float(k), 0.5, 0.1, 0.0, -0.99) for i in range(3) for k in (1, 2)], mixed.schema)
    oriented = normals.orient(mixed.unionByName(outer), (0, 0, 0), (0.0, 0.0, -1.0), max_component=1.0).cache()
    assert oriented.where("oriented").count() == 70
    assert oriented.where("kind = 'core' AND nz > 0").count() == 0
    depth = {(r.x, r.y): r.depth for r in oriented.where("kind = 'core'").collect()}
    assert depth[0, 0] == 0 and depth[1, 1] == 1 and max(depth.values()) >= 7
    assert normals.expansion(oriented, (0, 0, 0)).where("role = 'child'").count() == 3


def test_tiles_do_not_change_fits(spark):
    field = sheet(spark, 40, 3)
    found = {(r.x, r.y): (r.nx, r.ny, r.nz) for r in normals.fit(field, "3x3").collect()}
    assert len(found) == 120 and all(abs(n[2] - 1) < 1e-9 for n in found.values())


def test_paths(spark):
    links = [(i, i + 1, 1.0) for i in range(40)] + [(0, 40, 60.0), (5, 7, 1.5)]
    both = spark.createDataFrame(links + [(b, a, c) for a, b, c in links], "u long, v long, cost double")
    swept = paths.sweep(spark.createDataFrame([(0,)], "node long"), both).cache()
    dist = {r.node: r.dist for r in swept.collect()}
    assert dist[40] == 39.5 and dist[7] == 6.5 and dist[6] == 6
    found = [r.node for r in paths.route(swept, 40).orderBy("seq").collect()]
    assert found == [*range(6), *range(7, 41)]
    assert paths.sweep(spark.createDataFrame([(0,)], "node long"), both, 3.0).count() == 3


def test_brush_keeps_to_the_surface(spark):
    samples = spark.createDataFrame([(0, y, z, 1.0, 0.0, 0.0, 1.0) for y in range(-6, 7) if y != 2 for z in range(-3, 4)], "x int, y int, z int, nx double, ny double, nz double, planarity double")
    line = spark.createDataFrame([(0, 0, 0)], "x int, y int, z int")
    found = {(r.y, r.z): r for r in paths.brush(samples, line, SPACING, 0.4, 2.0).collect()}
    assert found[1, 0].dist == pytest.approx(0.31) and found[0, 1].dist == pytest.approx(1.0)
    assert found[1, 0].weight > found[0, 1].weight and not any(y > 1 for y, _ in found)


def test_radius_join_equals_all_pairs(spark):
    import random

    rng = random.Random(2)
    points = [(i, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(120)]
    df = spark.createDataFrame(points, "pid long, wx double, wy double, wz double")
    got = rows_of(radius_join(df, df, 0.5), "pid", "p_pid")
    assert got == {(a[0], b[0]) for a in points for b in points if math.dist(a[1:], b[1:]) <= 0.5}


def test_small_solvers(spark):
    df = spark.createDataFrame([(2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 4.0, 2.0, 6.0, 12.0), (0.0,) * 9 + (1.0, 1.0, 1.0)], ", ".join(f"m{i} double" for i in range(9)) + ", r0 double, r1 double, r2 double")
    out = linalg.solve(df, [f"m{i}" for i in range(9)], ["r0", "r1", "r2"], ["a", "b", "c"]).collect()
    assert (out[0].a, out[0].b, out[0].c) == (1, 2, 3) and out[1].a is None
    axis = linalg.eigenvector(df.select("m0", "m1", "m2", "m4", "m5", "m8"), ["m0", "m1", "m2", "m4", "m5", "m8"], ("nx", "ny", "nz"), largest=True).collect()
    assert tuple(axis[0])[-3:] == (0, 0, 1) and tuple(axis[1])[-3:] == (0, 0, 0)


def test_quadratic_fit_finds_the_surface(spark):
    rows = [(0, u / 10, w / 10, 1 + 2 * u / 10 - w / 10 + 0.5 * u * u / 100) for u in range(-5, 6) for w in range(-5, 6)]
    df = spark.createDataFrame(rows, "pid long, u double, v double, h double")
    q = clouds.solve_quadratic(clouds.quadratic_sums(df, "pid", F.col("u"), F.col("v"), F.col("h"), F.lit(1.0)), "pid", 1e-12).first()
    assert [round(q[f"q{i}"], 4) for i in range(6)] == [1, 2, -1, 0.5, 0, 0]


def test_spacing_is_from_the_last_kept_point(spark):
    df = spark.createDataFrame([(1, i, x, 0.0, 0.0) for i, x in enumerate((0.0, 0.6, 1.2, 1.3, 2.0, 2.3))], "stroke_id long, seq int, wx double, wy double, wz double")
    assert rows_of(strokes.spaced(df, 1.0), "seq") == {(0,), (2,), (5,)}
    with pytest.raises(ValueError):
        strokes.guarded(df, 5, "points")


def test_stores(spark, tmp_path):
    grid = layered(spark, 2, 2)
    facts = stores.fingerprint(grid, {"iso": 255.0})
    samples = target.classified(grid, target.TargetSettings())
    stores.save_with(samples, facts, str(tmp_path / "cache"))
    assert stores.load_if(spark, facts, str(tmp_path / "cache")).count() == 116
    assert stores.load_if(spark, stores.fingerprint(grid, {"iso": 254.0}), str(tmp_path / "cache")) is None
    assert stores.load_if(spark, facts, str(tmp_path / "none")) is None
    flips = spark.createDataFrame([(1, 2, 3, 1, "flip_point", None, True), (-4, 5, -6, 0, "flip_point", None, True), (7, 8, 9, 1, "seed", None, True)], "x int, y int, z int, target_sign short, kind string, color array<short>, accepted boolean")
    stores.save_lines(flips, str(tmp_path / "flips"))
    assert {(r.x, r.accepted) for r in stores.load_flips(spark, str(tmp_path / "flips")).collect()} == {(1, True), (-4, True), (7, False)}
    (tmp_path / "bad.json").write_text('{"x": 1}\n{broken\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        stores.load_flips(spark, str(tmp_path / "bad.json")).collect()


def test_stroke_logs(spark):
    fit = lambda n, anchors: [float(10 * anchors), float(anchors), *[0.0] * (n - 6), 5.0, 6.0, 7.0, 8.0]
    lines = [{"schema": 2, "stroke_id": "a", "points": [[0, 1, 2, 3]], "fits": [fit(16, 1), fit(16, 3)]}, {"schema": 1, "stroke_id": "b", "points": [], "fits": [fit(14, 2), fit(14, 1)]}, {"schema": 2, "stroke_id": "c", "points": [], "fits": [fit(14, 1)]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    rows = stores.load_strokes(df).collect()
    assert {r.stroke_id: r.valid for r in rows} == {"a": True, "b": False, "c": False}
    assert {(r.leaves, r.centerline, r.samples, r.triangles) for r in rows} == {(5, 6, 7, 8)}


def test_catalogue_and_presets(spark):
    lines = spark.createDataFrame([('{"label": "one", "path": "a/b.vdb", "default": true}',), ("",), ("{broken",), ('{"path": "/c/d.e.vdb"}',)], "value string")
    entries, counts = stores.catalog(lines, "/base")
    assert rows_of(entries, "label", "path", "is_default") == {("one", "/base/a/b.vdb", True), ("d.e", "/c/d.e.vdb", False)}
    assert tuple(counts.first()) == (1, 1, 2)
    preset = stores.presets(spark.createDataFrame([('{"name": "n", "core_mm": 5000, "strength": -1}',), ("{}",)], "value string")).collect()
    assert (preset[0].core_mm, preset[0].strength, preset[1].core_mm) == (1000.0, 0.0, 5.0)


def test_colours(spark):
    r = spark.range(1).select(*[c.alias(n) for c, n in zip(g.heat_color(F.lit(0.0)), "abcd", strict=True)], *[c.alias(n) for c, n in zip(g.heat_color(F.lit(1.0)), "efgh", strict=True)]).first()
    assert tuple(r) == (0, 0, 0, 0, 255, 0, 0, 255)


def test_probe(spark):
    from isovane.operators import recon

    grid = layered(spark, 2, 2)
    points = spark.createDataFrame([(0, 0.5 * SPACING[0], 0.0, 0.0), (1, -30.0, 0.0, 0.0)], "pid long, wx double, wy double, wz double")
    rows = {r.pid: r for r in recon.probe(grid, points, 255.0, tolerance=0.5).collect()}
    assert rows[0].converged and abs(rows[0].wx / SPACING[0]) < 0.01 and (rows[0].x, rows[0].y, rows[0].z) == (0, 0, 0)
    assert not rows[1].converged and rows[1].wx == -30.0 and rows[1].residual == -255.0


def test_reconstruction(spark):
    from isovane.operators import recon

    grid = layered(spark, 4, 3)
    settings = target.TargetSettings()
    samples = tiles.surface(grid, settings).cache()
    kinds = [r.kind for r in samples.collect()]
    assert (kinds.count("core"), kinds.count("transition")) == (226, 162)
    vertices, triangles, outcome = recon.reconstruct(grid, samples, recon.MlsSettings(radius=2.0, max_move=0.5))
    rows = vertices.collect()
    assert rows and triangles.count() > 0
    assert all(abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-3 for r in rows)
    found = outcome.first()
    assert found.vertices == len(rows) and found.farthest <= 0.5 + 1e-9 and found.fallback < 0.2 * len(rows)


def test_segment_and_box(spark):
    import random

    from isovane.operators import recon

    rng = random.Random(4)
    rows = [(i, *[rng.uniform(-3, 3) for _ in range(6)], *[rng.uniform(-1, 0) for _ in range(3)], *[rng.uniform(0, 1) for _ in range(3)]) for i in range(60)]
    names = ["ax", "ay", "az", "bx", "by", "bz", "lx", "ly", "lz", "hx", "hy", "hz"]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r.d2 for r in recon.segment_box_d2(df, ["i"], *[g.vector(*names[k : k + 3]) for k in (0, 3, 6, 9)]).collect()}
    for i, *c in rows:
        best = min(sum(max(c[6 + k] - p, p - c[9 + k], 0) ** 2 for k, p in enumerate(c[k] + (c[3 + k] - c[k]) * t / 2000 for k in range(3))) for t in range(2001))
        assert got[i] == pytest.approx(best, abs=5e-3) and got[i] <= best + 1e-12


def test_replayed_flips(spark):
    """Two reversed patches, each mended by its own flip; the baseline stays as it was."""
    field = sheet(spark, 12, 3, lambda i, j: i in (1, 2, 8, 9))
    mended = normals.replay(field, [(1, 1, 0), (8, 1, 0)])
    assert mended.where("nz < 0.99").count() == 0 and field.where("nz < 0").count() == 12
    assert normals.replay(field, []) is field


def test_components_of_samples_with_normals(spark):
    rows = [(x, 0, 0, "core", 0.0, 0.0, 0.0 if x == 2 else 1.0) for x in range(5)] + [(9, 0, 0, "transition", 0.0, 0.0, 1.0)]
    field = spark.createDataFrame(rows, "x int, y int, z int, kind string, nx double, ny double, nz double")
    found = normals.valid_components(field).collect()
    assert {r.x for r in found} == {0, 1, 3, 4} and len({r.component for r in found}) == 2
    assert normals.valid_components(field.where("x > 5")).count() == 0
