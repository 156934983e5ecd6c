"""Queries on grids, surface samples, bricks and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import bricks, slices, stencil, target, tiles
from isovane.sources import voxels as v

KEY = ["x", "y", "z"]
SETTINGS = {"layers": 2, "planarity_radius": 1.2}
SX, SY, SZ = 0.31, 0.31, 1.0


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _grid(spark, sf_dir):
    grid = v.from_lineitem(spark, sf_dir)
    return grid, v.level_of(grid)


def _settings(iso: float) -> target.TargetSettings:
    return target.TargetSettings(iso=iso, **SETTINGS)


def core_voxels(spark, sf_dir) -> DataFrame:
    return target.core_voxels(*_grid(spark, sf_dir))


def leaf_scan(spark, sf_dir) -> DataFrame:
    return bricks.leaves(v.from_lineitem(spark, sf_dir).voxels)


def active_scan(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return grid.voxels.where(F.col("active") & grid.inside(F.col("value"), iso)).select(*KEY, "value")


def background_lookup(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    looked = stencil.gather(grid.voxels.select(*KEY), grid.voxels, [(5, 0, 0), (0, 3, 0), (0, 0, -7)], grid.background)
    return looked.select(*KEY, "v0", "v1", "v2")


def world_positions(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    w = g.to_world(grid, *map(F.col, KEY))
    off = g.to_index(grid, w[0] + 0.1, w[1] - 0.1, w[2] + 0.4)
    return grid.voxels.select(*KEY, *[r6(c).alias(n) for c, n in zip(w, ("wx", "wy", "wz"), strict=True)], *[g.nearest(c).alias(n) for c, n in zip(off, ("ix", "iy", "iz"), strict=True)])


def axis_crossings(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.crossings(grid, target.core_voxels(grid, iso), iso)
    return found.select(*KEY, "dx", "dy", "dz", r6(F.col("t")).alias("t"))


def central_gradients(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.central_gradient(grid, target.core_voxels(grid, iso))
    unit = g.normalized(g.vector("gx", "gy", "gz"))
    return found.select(*KEY, *[r6(F.col(c)).alias(c) for c in ("gx", "gy", "gz")], *[r6(c).alias(n) for c, n in zip(unit, ("nx", "ny", "nz"), strict=True)])


def trilinear_samples(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    points = target.core_voxels(grid, iso).select((F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"), (F.col("z") - 0.25).alias("pz"))
    found = target.trilinear(grid, points)
    return found.select("px", "py", "pz", *[r6(F.col(c)).alias(c) for c in ("sampled", "tx", "ty", "tz")])


def transition_layers(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return target.transition_layers(grid, target.core_voxels(grid, iso), iso, 2).select(*KEY, "value", F.col("layer").cast("int").alias("layer"))


def classified(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.classified(grid, _settings(iso))
    return found.select(*KEY, "value", "kind", F.col("layer").cast("int").alias("layer"), r6(F.col("support")).alias("support"))


def sample_ids(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return target.with_ids(target.classified(grid, _settings(iso)).select(*KEY, "kind")).select("sample_id", *KEY, "kind")


def surface_normals(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = tiles.surface(grid, _settings(iso))
    return found.select(*KEY, "kind", *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


def planarity(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.extract(grid, _settings(iso)).where("kind = 'core'")
    return found.select(*KEY, *[(F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in ("planarity", "deviation")])


def surface_target(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.extract(grid, _settings(iso))
    return found.groupBy("kind", F.col("layer").cast("int").alias("layer")).agg(F.count("*").alias("n"), F.round(F.sum("support"), 3).alias("support"), F.round(F.sum("density"), 3).alias("density"))


def components(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    found = target.components(target.core_voxels(grid, iso))
    a = target.unpack_key(F.col("component"))
    return found.select(*KEY, *[c.alias(n) for c, n in zip(a, ("cx", "cy", "cz"), strict=True)])


def largest_component(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    groups = target.components(target.core_voxels(grid, iso))
    best = target.largest(groups)
    a = target.unpack_key(F.col("component"))
    return best.select(*[c.alias(n) for c, n in zip(a, ("cx", "cy", "cz"), strict=True)], F.col("n").alias("size"))


def primary_split(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return target.split_primary(target.classified(grid, _settings(iso))).select(*KEY, "kind", "primary")


def excluded_samples(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    samples = target.classified(grid, _settings(iso)).select(*KEY, "kind", "layer")
    primary = target.split_primary(samples).where("primary").select(*KEY)
    return samples.join(primary, KEY, "left_anti").select(*KEY, "kind")


def brick_import(spark, sf_dir) -> DataFrame:
    found = bricks.from_grid(v.from_lineitem(spark, sf_dir))
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.cast("double"))
    bits = F.aggregate("words", F.lit(0), lambda a, w: a + F.bit_count(w).cast("int"))
    return found.select("bi", "bj", "bk", "morton", "active_count", total.alias("total"), bits.alias("mask_bits"), F.element_at("words", 1).alias("first_word"))


def brick_export(spark, sf_dir) -> DataFrame:
    return bricks.to_voxels(bricks.from_grid(v.from_lineitem(spark, sf_dir)))


def brick_bit_test(spark, sf_dir) -> DataFrame:
    return bricks.is_active(bricks.from_grid(v.from_lineitem(spark, sf_dir)), 77)


def brick_neighbours(spark, sf_dir) -> DataFrame:
    found = bricks.neighbour_table(bricks.leaves(v.from_lineitem(spark, sf_dir).voxels))
    there = F.col("neighbour") != bricks.NONE
    a = target.unpack_key(F.col("neighbour"))
    return found.select("bi", "bj", "bk", "slot", *[F.when(there, c).alias(n) for c, n in zip(a, ("nbi", "nbj", "nbk"), strict=True)])


def brick_validation(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    other = grid.voxels.where("(x + y + z) % 11 <> 0").select(*KEY, F.when(F.expr("x % 5 = 0"), F.col("value") + 1).otherwise(F.col("value")).alias("value"), F.expr("z % 7 <> 0").alias("active"))
    shifted = other.where("x = 3").select((F.col("x") + 100).alias("x"), "y", "z", "value", "active")
    return bricks.validate(grid.voxels, other.unionByName(shifted))


def slice_pixels(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    return slices.with_gray(slices.extract(grid, "z", 15)[0])


def slice_contours(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    pixels, width, height = slices.extract(grid, "y", 4)
    found = slices.levels(pixels, [iso, iso / 2], iso, width, height)
    return found.select(*[r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1", "level")])


def slice_overlay(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return slices.overlay(target.classified(grid, _settings(iso)), "z", 15)


def union_levels(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return target.core_voxels(grid, iso).select(*KEY).unionByName(target.core_voxels(grid, iso - 1).select(*KEY)).dropDuplicates(KEY)


def bounds(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    return grid.voxels.where("active").agg(*[f(k).alias(f"{n}_{k}") for k in KEY for n, f in (("min", F.min), ("max", F.max))])


def stride_sample(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    return target.with_ids(target.core_voxels(grid, iso).select(*KEY)).where("sample_id % 7 = 0").select("sample_id", *KEY, F.pmod("sample_id", F.lit(10)).alias("palette"))


QUERIES = {
    "a2_leaf_scan": leaf_scan, "a3_active_scan": active_scan, "a4_background_lookup": background_lookup, "a5_brick_import": brick_import, "a6_brick_export": brick_export,
    "b2_b3_world_positions": world_positions, "b4_axis_crossings": axis_crossings, "b5_central_gradients": central_gradients, "b6_b7_trilinear": trilinear_samples,
    "b9_f1_classified": classified, "b10_planarity": planarity, "b14_brick_bit_test": brick_bit_test, "b26_h12_slice_pixels": slice_pixels, "c1_core_voxels": core_voxels,
    "c4_brick_neighbours": brick_neighbours, "c6_transition_layers": transition_layers, "c7_f2_primary_split": primary_split, "c9_excluded_samples": excluded_samples,
    "c23_d18_brick_validation": brick_validation, "c25_slice_overlay": slice_overlay, "d1_f4_union_levels": union_levels, "d3_surface_normals": surface_normals,
    "d11_largest_component": largest_component, "d13_bounds": bounds, "e6_sample_ids": sample_ids, "e7_e14_stride_sample": stride_sample,
    "g1_components": components, "h1_surface_target": surface_target, "h13_slice_contours": slice_contours,
}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts)


def _values(offsets, name: str = "o") -> str:
    rows = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(offsets))
    return f"{name}(slot, dx, dy, dz) AS (VALUES {rows})"


VOX = v.SQL_VOXELS
CORE = """
core AS (
  SELECT v.x, v.y, v.z, v.value, CAST(count(*) AS INTEGER) AS crossings
  FROM vox v CROSS JOIN six s LEFT JOIN vox n ON n.x = v.x + s.dx AND n.y = v.y + s.dy AND n.z = v.z + s.dz, iso
  WHERE v.value >= iso.iso AND coalesce(n.value, 0) < iso.iso GROUP BY ALL)"""
SIX = _values(stencil.SIX, "six")
DIAMOND = _values(stencil.diamond(2), "diamond")
TRANSITION = """
trans AS (
  SELECT v.x, v.y, v.z, v.value, CAST(min(abs(d.dx) + abs(d.dy) + abs(d.dz)) AS INTEGER) AS layer
  FROM core c CROSS JOIN diamond d JOIN vox v ON v.x = c.x + d.dx AND v.y = c.y + d.dy AND v.z = c.z + d.dz, iso
  WHERE v.value < iso.iso AND v.value <> 0 GROUP BY v.x, v.y, v.z, v.value)"""
SAMPLES = """
samples AS (
  SELECT x, y, z, value, 'core' AS kind, 0 AS layer, CAST(1 AS DOUBLE) AS support FROM core
  UNION ALL
  SELECT x, y, z, value, 'transition', layer, (1 - layer / 3.0::DOUBLE) * least(greatest(value / iso.iso, 0), 1) FROM trans, iso)"""
ALL_SAMPLES = (VOX, SIX, CORE, DIAMOND, TRANSITION, SAMPLES)
BOX = _values(stencil.box(1), "box26")
REACH = """
edges AS (
  SELECT (a.x * 100 + a.y) * 100 + a.z AS u, (b.x * 100 + b.y) * 100 + b.z AS w
  FROM core a CROSS JOIN box26 o JOIN core b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
reach(node, label) AS (
  SELECT (x * 100 + y) * 100 + z, (x * 100 + y) * 100 + z FROM core
  UNION
  SELECT e.w, r.label FROM reach r JOIN edges e ON e.u = r.node WHERE r.label < e.w),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
sizes AS (SELECT label, count(*) AS n FROM comp GROUP BY label),
best AS (SELECT label, n FROM sizes ORDER BY n DESC, label LIMIT 1)"""
PRIMARY = """
main AS (SELECT node FROM comp JOIN best USING (label)),
pick AS (
  SELECT DISTINCT s.x, s.y, s.z FROM samples s CROSS JOIN wide d JOIN main m
    ON m.node = ((s.x + d.dx) * 100 + s.y + d.dy) * 100 + s.z + d.dz
  WHERE s.kind = 'transition' AND abs(d.dx) + abs(d.dy) + abs(d.dz) <= greatest(s.layer, 1)
  UNION SELECT s.x, s.y, s.z FROM samples s JOIN main m ON m.node = (s.x * 100 + s.y) * 100 + s.z WHERE s.kind = 'core')"""
WIDE = _values(stencil.diamond(2, center=True), "wide")
CONNECTED = (*ALL_SAMPLES, BOX, REACH, WIDE, PRIMARY)


def _at(dx: int, dy: int, dz: int) -> str:
    """The value next to row ``c``, background 0."""
    return f"coalesce((SELECT value FROM vox n WHERE n.x = c.x + {dx} AND n.y = c.y + {dy} AND n.z = c.z + {dz}), 0)"


def _unit(a: str, b: str, c: str, part: str) -> str:
    return f"CASE WHEN sqrt({a}*{a} + {b}*{b} + {c}*{c}) > 1e-20 THEN {part} / sqrt({a}*{a} + {b}*{b} + {c}*{c}) ELSE 0 END"


#: Offsets whose values decide the gradients at all six crossings of a voxel.
_AROUND = [(0, 0, 0), *stencil.SIX, (1, 1, 0), (-1, 1, 0), (1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (0, 1, 1), (0, -1, 1), (0, 1, -1)]


def _normals_sql() -> str:
    """Gathered values a0.. for each sample, then the summed unit gradients over its crossings."""
    around = _AROUND
    name = {o: f"a{i}" for i, o in enumerate(around)}
    wide = "wide_samples AS (SELECT c.*, " + ", ".join(f"{_at(*o)} AS a{i}" for i, o in enumerate(around)) + " FROM samples c)"
    sides = []
    for axis in range(3):
        for sign in (1, -1):
            e = lambda a, s=1: tuple(s if i == a else 0 for i in range(3))
            there = name[e(axis, sign)]
            t = f"CASE WHEN abs({there} - a0) > 1e-12 THEN least(greatest((iso.iso - a0) / ({there} - a0), 0), 1) ELSE 0.5 END"
            cells = []
            for a in range(3):
                if a == axis:
                    forward = f"{name[e(axis)]} - a0"
                    cells.append(forward if sign > 0 else f"CASE WHEN ({t}) > 0 THEN a0 - {name[e(axis, -1)]} ELSE {forward} END")
                else:
                    near = f"({name[e(a)]} - a0)"
                    far = f"({name[tuple(p + q for p, q in zip(e(axis, sign), e(a), strict=True))]} - {there})"
                    cells.append(f"{near} + ({t}) * ({far} - {near})")
            world = [f"({c}) * (-1.0::DOUBLE / {s}::DOUBLE)" for c, s in zip(cells, (SX, SY, SZ), strict=True)]
            sides.append(f"SELECT x, y, z, {', '.join(f'{w} AS w{i}' for i, w in enumerate(world))} FROM wide_samples, iso WHERE kind = 'core' AND a0 >= iso.iso AND {there} < iso.iso")
    unit = ", ".join(f"sum({_unit('w0', 'w1', 'w2', f'w{i}')}) AS g{i}" for i in range(3))
    crossed = "crossed AS (" + "\nUNION ALL ".join(sides) + f"),\ncore_sum AS (SELECT x, y, z, {unit} FROM crossed GROUP BY x, y, z)"
    ahead = ", ".join(f"(a{1 + 2 * a} - a0) * (-1.0::DOUBLE / {s}::DOUBLE) AS g{a}" for a, s in enumerate((SX, SY, SZ)))
    central = ", ".join(f"(a{1 + 2 * a} - a{2 + 2 * a}) * (-0.5::DOUBLE / {s}::DOUBLE) AS c{a}" for a, s in enumerate((SX, SY, SZ)))
    first = f"""firsts AS (
      SELECT w.x, w.y, w.z, w.kind, {', '.join(f"CASE WHEN w.kind = 'core' THEN s.g{i} ELSE f.g{i} END AS g{i}" for i in range(3))}, c0, c1, c2
      FROM (SELECT *, {central} FROM wide_samples) w LEFT JOIN core_sum s USING (x, y, z) JOIN (SELECT x, y, z, {ahead} FROM wide_samples) f USING (x, y, z))"""
    chosen = ", ".join(f"CASE WHEN sqrt(g0*g0 + g1*g1 + g2*g2) > 1e-20 THEN {_unit('g0', 'g1', 'g2', f'g{i}')} ELSE {_unit('c0', 'c1', 'c2', f'c{i}')} END AS {n}" for i, n in enumerate(("nx", "ny", "nz")))
    return ",\n".join([wide, crossed, first, f"normals AS (SELECT x, y, z, kind, {chosen} FROM firsts)"])


NORMALS = _normals_sql()
PLANAR = f"""
near AS (
  SELECT c.x, c.y, c.z, exp(-(o.dx*o.dx*{SX}*{SX} + o.dy*o.dy*{SY}*{SY} + o.dz*o.dz) * (0.5 / (0.6 * 0.6))::DOUBLE) AS w,
         CASE WHEN c.nx*n.nx + c.ny*n.ny + c.nz*n.nz < 0 THEN -1 ELSE 1 END AS side, n.nx, n.ny, n.nz
  FROM normals c CROSS JOIN box26 o JOIN normals n ON n.x = c.x + o.dx AND n.y = c.y + o.dy AND n.z = c.z + o.dz
  WHERE c.kind = 'core' AND n.kind = 'core' AND c.nx*c.nx + c.ny*c.ny + c.nz*c.nz > 1e-20 AND n.nx*n.nx + n.ny*n.ny + n.nz*n.nz > 1e-20
    AND o.dx*o.dx*{SX}*{SX} + o.dy*o.dy*{SY}*{SY} + o.dz*o.dz <= 1.44),
tot AS (SELECT x, y, z, sum(w) AS w, sum(side * w * nx) AS s0, sum(side * w * ny) AS s1, sum(side * w * nz) AS s2 FROM near GROUP BY ALL),
dev AS (
  SELECT c.x, c.y, c.z, coalesce(t.w, 0) AS w, nx*nx + ny*ny + nz*nz > 1e-20 AS good,
         sqrt(-2 * ln(CASE WHEN t.w > 0 THEN least(greatest(sqrt(s0*s0 + s1*s1 + s2*s2) / t.w, 1e-12), 1) ELSE 1e-12 END)) AS d
  FROM normals c LEFT JOIN tot t USING (x, y, z) WHERE c.kind = 'core')"""


def _round4(expr: str) -> str:
    return f"round(CAST(CAST({expr} AS REAL) AS DOUBLE), 4) + 0.0"


_corner = {o: f"k{i}" for i, o in enumerate(target.CORNERS)}


def _trilinear(derive: int | None) -> str:
    f = ("0.25", "0.5", "0.75")
    terms = []
    for o, k in _corner.items():
        parts = [k]
        for a, bit in enumerate(o):
            parts.append(("1" if bit else "-1") if a == derive else (f[a] if bit else f"(1 - {f[a]})"))
        terms.append("*".join(parts))
    return "(" + " + ".join(terms) + ")"


_BLOCK = "(SELECT bi, bj, bk, count(*) AS n FROM leaf GROUP BY ALL)"
LEAF = "leaf AS (SELECT *, CAST(floor(x / 8.0) AS INTEGER) AS bi, CAST(floor(y / 8.0) AS INTEGER) AS bj, CAST(floor(z / 8.0) AS INTEGER) AS bk, (x & 7) * 64 + (y & 7) * 8 + (z & 7) AS cell FROM vox)"
PLANE_Z = """
pix AS (SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col
  FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM vox) b, range(0, b.y1 - b.y0 + 1) r, range(0, b.x1 - b.x0 + 1) c),
img AS (SELECT p.row, p.col, coalesce(v.value, 0) AS value FROM pix p, (SELECT min(x) AS x0, min(y) AS y0 FROM vox) b
  LEFT JOIN vox v ON v.z = 15 AND v.x = p.col + b.x0 AND v.y = p.row + b.y0)"""
PLANE_Y = PLANE_Z.replace("y0", "z0").replace("y1", "z1").replace("min(y)", "min(z)").replace("max(y)", "max(z)").replace("v.z = 15 AND v.x = p.col + b.x0 AND v.y = p.row", "v.y = 4 AND v.x = p.col + b.x0 AND v.z = p.row")


def _contour_sql() -> str:
    """Crossings of the four sides in order, then pairs of them."""
    ends = {0: ("v0", "v1", "col", "row", "col + 1", "row"), 1: ("v1", "v2", "col + 1", "row", "col + 1", "row + 1"), 2: ("v2", "v3", "col + 1", "row + 1", "col", "row + 1"), 3: ("v3", "v0", "col", "row + 1", "col", "row")}
    sides = []
    for k, (a, b, ax, ay, bx, by) in ends.items():
        t = f"(CASE WHEN abs({b} - {a}) > 1e-12 THEN least(greatest((level - {a}) / ({b} - {a}), 0), 1) ELSE 0.5 END)"
        point = f"{{'x': ({ax} + (({bx}) - ({ax})) * {t}) / w, 'y': 1 - ({ay} + (({by}) - ({ay})) * {t}) / h}}"
        sides.append(f"CASE WHEN ({a} < level) <> ({b} < level) THEN {point} END")
    return f"""
dim AS (SELECT greatest(max(col), 1)::DOUBLE AS w, greatest(max(row), 1)::DOUBLE AS h FROM img),
lev AS (SELECT iso AS level FROM iso UNION SELECT iso / 2 FROM iso),
cell AS (SELECT a.row, a.col, a.value AS v0, b.value AS v1, c.value AS v2, d.value AS v3, level, w, h FROM img a
  JOIN img b ON b.row = a.row AND b.col = a.col + 1 JOIN img c ON c.row = a.row + 1 AND c.col = a.col + 1 JOIN img d ON d.row = a.row + 1 AND d.col = a.col, lev, dim),
hit AS (SELECT level, (v0 + v1 + v2 + v3) * 0.25 >= level AS full_, list_filter([{", ".join(sides)}], lambda p: p IS NOT NULL) AS hits FROM cell),
pair AS (
  SELECT level, hits[1] AS a, hits[2] AS b FROM hit WHERE len(hits) = 2
  UNION ALL SELECT level, hits[1], CASE WHEN full_ THEN hits[4] ELSE hits[2] END FROM hit WHERE len(hits) = 4
  UNION ALL SELECT level, CASE WHEN full_ THEN hits[2] ELSE hits[3] END, CASE WHEN full_ THEN hits[3] ELSE hits[4] END FROM hit WHERE len(hits) = 4)"""


def _morton(x: str, y: str, z: str) -> str:
    bits = [f"((({c}) >> {i}) & 1)::BIGINT << {3 * i + j}" for i in range(3) for j, c in enumerate((x, y, z))]
    return "(" + " | ".join(f"({b})" for b in bits) + ")"


SQL = {
    "a2_leaf_scan": _with(VOX, LEAF) + " SELECT bi, bj, bk, count(*) AS n, count(*) AS active FROM leaf GROUP BY ALL",
    "a3_active_scan": _with(VOX) + " SELECT x, y, z, value FROM vox, iso WHERE value >= iso",
    "a4_background_lookup": _with(VOX) + f" SELECT x, y, z, CAST({_at(5, 0, 0)} AS DOUBLE) AS v0, CAST({_at(0, 3, 0)} AS DOUBLE) AS v1, CAST({_at(0, 0, -7)} AS DOUBLE) AS v2 FROM vox c",
    "a5_brick_import": _with(VOX, LEAF) + f""", low AS (SELECT min(bi) AS mx, min(bj) AS my, min(bk) AS mz FROM leaf)
      SELECT bi, bj, bk, {_morton('bi - mx', 'bj - my', 'bk - mz')} AS morton, CAST(count(*) AS INTEGER) AS active_count, sum(value) AS total,
             CAST(count(*) AS INTEGER) AS mask_bits,
             CAST(coalesce(sum(CASE WHEN cell < 63 THEN 1::HUGEINT << cell::INTEGER WHEN cell = 63 THEN -(1::HUGEINT << 63) END), 0) AS BIGINT) AS first_word
      FROM leaf, low GROUP BY bi, bj, bk, mx, my, mz""",
    "a6_brick_export": _with(VOX) + " SELECT x, y, z, value, true AS active FROM vox",
    "b2_b3_world_positions": _with(VOX) + f""", w AS (SELECT x, y, z, {SX}::DOUBLE * x AS wx, {SY}::DOUBLE * y AS wy, {SZ}::DOUBLE * z AS wz FROM vox)
      SELECT x, y, z, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz,
             CAST(round((wx + 0.1) / {SX}::DOUBLE) AS INTEGER) AS ix, CAST(round((wy - 0.1) / {SY}::DOUBLE) AS INTEGER) AS iy, CAST(round((wz + 0.4) / {SZ}::DOUBLE) AS INTEGER) AS iz FROM w""",
    "b4_axis_crossings": _with(VOX, SIX, CORE) + """, p AS (
      SELECT c.*, s.dx, s.dy, s.dz, coalesce(n.value, 0) AS other FROM core c CROSS JOIN six s LEFT JOIN vox n ON n.x = c.x + s.dx AND n.y = c.y + s.dy AND n.z = c.z + s.dz)
      SELECT x, y, z, dx, dy, dz, round(CASE WHEN abs(other - value) > 1e-12 THEN least(greatest((iso - value) / (other - value), 0), 1) ELSE 0.5 END, 6) + 0.0 AS t FROM p, iso WHERE other < iso""",
    "b5_central_gradients": _with(VOX, SIX, CORE) + f""", g AS (SELECT x, y, z, ({_at(1, 0, 0)} - {_at(-1, 0, 0)}) * (-0.5 / {SX})::DOUBLE AS gx, ({_at(0, 1, 0)} - {_at(0, -1, 0)}) * (-0.5 / {SY})::DOUBLE AS gy, ({_at(0, 0, 1)} - {_at(0, 0, -1)}) * (-0.5 / {SZ})::DOUBLE AS gz FROM core c)
      SELECT x, y, z, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(gz, 6) + 0.0 AS gz, round({_unit('gx', 'gy', 'gz', 'gx')}, 6) + 0.0 AS nx, round({_unit('gx', 'gy', 'gz', 'gy')}, 6) + 0.0 AS ny, round({_unit('gx', 'gy', 'gz', 'gz')}, 6) + 0.0 AS nz FROM g""",
    "b6_b7_trilinear": _with(VOX, SIX, CORE) + ", k AS (SELECT x, y, z, " + ", ".join(f"{_at(a, b, c - 1)} AS {n}" for (a, b, c), n in _corner.items()) + f""" FROM core c)
      SELECT CAST(x + 0.25 AS DOUBLE) AS px, CAST(y + 0.5 AS DOUBLE) AS py, CAST(z - 0.25 AS DOUBLE) AS pz, round({_trilinear(None)}, 6) + 0.0 AS sampled,
             round({_trilinear(0)} * (-1.0 / {SX})::DOUBLE, 6) + 0.0 AS tx, round({_trilinear(1)} * (-1.0 / {SY})::DOUBLE, 6) + 0.0 AS ty, round({_trilinear(2)} * (-1.0 / {SZ})::DOUBLE, 6) + 0.0 AS tz FROM k""",
    "b9_f1_classified": _with(*ALL_SAMPLES) + " SELECT x, y, z, value, kind, layer, round(support, 6) + 0.0 AS support FROM samples",
    "b10_planarity": _with(*ALL_SAMPLES, NORMALS, BOX, PLANAR) + f""" SELECT x, y, z, CASE WHEN good THEN {_round4('(1 - exp(-w / 3.0)) * exp(-(d / radians(15.0)) * (d / radians(15.0)))')} ELSE 0 END AS planarity, CASE WHEN good THEN {_round4('d')} ELSE 0 END AS deviation FROM dev""",
    "b14_brick_bit_test": _with(VOX, LEAF) + ' SELECT bi, bj, bk, bool_or(cell = 77) AS "on" FROM leaf GROUP BY ALL',
    "b26_h12_slice_pixels": _with(VOX, PLANE_Z) + " SELECT row, col, value, CAST(floor(least(greatest(value / (SELECT max(value) FROM img), 0), 1) * 255 + 0.5) AS INTEGER) AS gray FROM img",
    "c1_core_voxels": _with(VOX, SIX, CORE) + " SELECT * FROM core",
    "c4_brick_neighbours": _with(VOX, LEAF, BOX) + f", b AS {_BLOCK} SELECT b.bi, b.bj, b.bk, o.slot, n.bi AS nbi, n.bj AS nbj, n.bk AS nbk FROM b CROSS JOIN box26 o LEFT JOIN b n ON n.bi = b.bi + o.dx AND n.bj = b.bj + o.dy AND n.bk = b.bk + o.dz",
    "c6_transition_layers": _with(VOX, SIX, CORE, DIAMOND, TRANSITION) + " SELECT * FROM trans",
    "c7_f2_primary_split": _with(*CONNECTED) + ' SELECT s.x, s.y, s.z, s.kind, p.x IS NOT NULL AS "primary" FROM samples s LEFT JOIN pick p ON p.x = s.x AND p.y = s.y AND p.z = s.z',
    "c9_excluded_samples": _with(*CONNECTED) + " SELECT x, y, z, kind FROM samples s WHERE NOT EXISTS (SELECT 1 FROM pick p WHERE p.x = s.x AND p.y = s.y AND p.z = s.z)",
    "c23_d18_brick_validation": _with(VOX) + """, other AS (
      SELECT x, y, z, CASE WHEN x % 5 = 0 THEN value + 1 ELSE value END AS value, z % 7 <> 0 AS active FROM vox WHERE (x + y + z) % 11 <> 0),
      b AS (SELECT * FROM other UNION ALL SELECT x + 100, y, z, value, active FROM other WHERE x = 3),
      f AS (SELECT a.value AS va, b.value AS vb, a.x AS ax, b.x AS bi, b.active AS ab FROM vox a FULL JOIN b ON a.x = b.x AND a.y = b.y AND a.z = b.z)
      SELECT count(*) FILTER (WHERE bi IS NULL) AS missing, count(*) FILTER (WHERE ax IS NULL) AS extra, count(*) FILTER (WHERE ax IS NOT NULL AND bi IS NOT NULL AND NOT ab) AS active_mismatch,
             count(*) FILTER (WHERE va <> vb) AS value_mismatch, coalesce(max(abs(va - vb)), 0) AS max_error FROM f""",
    "c25_slice_overlay": _with(*ALL_SAMPLES) + " SELECT y AS row, x AS col, kind FROM samples WHERE z = 15",
    "d1_f4_union_levels": _with(VOX, SIX, CORE) + """, lower AS (SELECT DISTINCT v.x, v.y, v.z FROM vox v CROSS JOIN six s LEFT JOIN vox n ON n.x = v.x + s.dx AND n.y = v.y + s.dy AND n.z = v.z + s.dz, iso
      WHERE v.value >= iso.iso - 1 AND coalesce(n.value, 0) < iso.iso - 1) SELECT x, y, z FROM core UNION SELECT * FROM lower""",
    "d3_surface_normals": _with(*ALL_SAMPLES, NORMALS) + " SELECT x, y, z, kind, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM normals",
    "d11_largest_component": _with(VOX, SIX, CORE, BOX, REACH) + " SELECT CAST(label // 10000 AS INTEGER) AS cx, CAST(label // 100 % 100 AS INTEGER) AS cy, CAST(label % 100 AS INTEGER) AS cz, n AS size FROM best",
    "d13_bounds": _with(VOX) + " SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM vox",
    "e6_sample_ids": _with(*ALL_SAMPLES) + " SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS sample_id, x, y, z, kind FROM samples",
    "e7_e14_stride_sample": _with(VOX, SIX, CORE) + " SELECT sample_id, x, y, z, sample_id % 10 AS palette FROM (SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS sample_id, x, y, z FROM core) WHERE sample_id % 7 = 0",
    "g1_components": _with(VOX, SIX, CORE, BOX, REACH) + " SELECT CAST(node // 10000 AS INTEGER) AS x, CAST(node // 100 % 100 AS INTEGER) AS y, CAST(node % 100 AS INTEGER) AS z, CAST(label // 10000 AS INTEGER) AS cx, CAST(label // 100 % 100 AS INTEGER) AS cy, CAST(label % 100 AS INTEGER) AS cz FROM comp",
    "h1_surface_target": _with(*ALL_SAMPLES) + " SELECT kind, layer, count(*) AS n, round(sum(support), 3) AS support, round(sum(value), 3) AS density FROM samples GROUP BY ALL",
    "h13_slice_contours": _with(VOX, PLANE_Y, _contour_sql()) + " SELECT round(a.x, 6) + 0.0 AS x0, round(a.y, 6) + 0.0 AS y0, round(b.x, 6) + 0.0 AS x1, round(b.y, 6) + 0.0 AS y1, round(level, 6) + 0.0 AS level FROM pair",
}
