"""Queries on point clouds, strokes, weights, paths and stores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import clouds, normals, paths, strokes, target, tiles
from isovane.operators.stencil import KEY, box, radius_join, shifted
from isovane.plans.lineage import cut
from isovane.queries.normal_fields import ROUNDED, _normals, _samples
from isovane.queries.surface import ALL_SAMPLES, BOX, CORE, NORMALS, PLANAR, SETTINGS, SIX, SX, SY, SZ, VOX, _at, _grid, _unit, _values, _with, r6
from isovane.sources import stores
from isovane.sources import voxels as v

RADIUS = 0.12


def _points(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "embeddings")
    at = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    n = g.normalized(tuple(F.element_at("embedding", i).cast("double") for i in (4, 5, 6)))
    return e.select(F.col("vec_id").alias("pid"), *[c.alias(k) for c, k in zip(at, clouds.WORLD, strict=True)], *[c.alias(k) for c, k in zip(n, ("nx", "ny", "nz"), strict=True)], "label")


def within_radius(spark, sf_dir) -> DataFrame:
    """All pairs of points within the radius, every point asked for."""
    p = _points(spark, sf_dir).select("pid", *clouds.WORLD)
    return radius_join(p, p, RADIUS).select("pid", "p_pid", r6(F.col("d2")).alias("d2"))


def nearest_k(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir).select("pid", *clouds.WORLD)
    found = clouds.nearest(radius_join(p, p, RADIUS).where("pid <> p_pid"), "pid", "p_pid", 4)
    return found.select("pid", "p_pid", "rank", r6(F.col("d2")).alias("d2"))


def kernel_means(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir).select("pid", *clouds.WORLD, "nx", "ny", "nz")
    found = clouds.anchors(p, p, RADIUS)
    return found.select("pid", "n", *[r6(F.col(c)).alias(c) for c in ("weight", "ax", "ay", "az")])


def _quadratic(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir).select("pid", *clouds.WORLD)
    pairs = radius_join(p, p, 0.2)
    u, w, h = (F.col(f"p_{c}") - F.col(c) for c in clouds.WORLD)
    return clouds.quadratic_sums(pairs, "pid", u, w, h, g.wendland(F.sqrt("d2") / 0.2))


def quadratic_sums(spark, sf_dir) -> DataFrame:
    s = _quadratic(spark, sf_dir)
    return s.select("pid", "n", *[r6(F.col(c)).alias(c) for c in ("w", "m00", "m12", "m33", "m55", "r0", "r3")])


def quadratic_fit(spark, sf_dir) -> DataFrame:
    return clouds.solve_quadratic(_quadratic(spark, sf_dir), "pid")


def nearest_in_box(grid: v.Grid, core: DataFrame, shift: tuple[float, float, float] = (0.01, 0.02, 0.03)) -> DataFrame:
    """(x, y, z, core_x, core_y, core_z, d2): for a point ``shift`` off each voxel, the nearest core sample within 4 voxels along each axis.

    Each core voxel goes to the 729 places around it, where partial minima keep the nearest; ties go to the smallest (x, y, z).
    """
    d2 = sum((F.col(d) * F.lit(float(s)) - F.lit(o)) * (F.col(d) * F.lit(float(s)) - F.lit(o)) for d, s, o in zip(("dx", "dy", "dz"), grid.spacing, shift, strict=True))
    sent = shifted(core.select(*KEY), box(4, center=True), -1).select("qx", "qy", "qz", F.struct(F.round(d2, 9).alias("d2"), *KEY).alias("m"))
    best = sent.groupBy(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")).agg(F.min("m").alias("m"))
    return grid.voxels.select(*KEY).join(best, KEY).select(*KEY, *[F.col(f"m.{k}").alias(f"core_{k}") for k in KEY], F.col("m.d2").alias("d2"))


def nearest_sample(spark, sf_dir) -> DataFrame:
    """For every voxel, the nearest core sample in the whole box of 4 voxels along each axis."""
    grid, iso = _grid(spark, sf_dir)
    found = nearest_in_box(grid, target.core_voxels(grid, iso))
    return found.select(*KEY, "core_x", "core_y", "core_z", r6(F.col("d2")).alias("d2"))


def lookups(spark, sf_dir) -> DataFrame:
    """C15: the sample at each asked place, where a core sample is there; places are asked for by their line of an order."""
    grid, iso = _grid(spark, sf_dir)
    asked = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pid"), *[F.expr(e).cast("int").alias(k) for k, e in zip(KEY, ("o_orderkey % 30", "o_custkey % 12", "o_orderkey % 35"), strict=True)])
    return target.core_at(asked, target.core_voxels(grid, iso)).select("pid", *KEY, "value", "crossings")


def voxel_areas(spark, sf_dir) -> DataFrame:
    """D20 and D24: each core sample's area in mm2 on its tangent plane."""
    grid, field = _normals(spark, sf_dir)
    core = field.where("kind = 'core' AND (nx <> 0 OR ny <> 0 OR nz <> 0)")
    return core.select(*KEY, F.round(g.voxel_area(g.vector("nx", "ny", "nz"), grid.spacing) / 1e6, 5).alias("m2"))


def mean_planarity(spark, sf_dir) -> DataFrame:
    """D24: the mean planarity of the core samples."""
    grid, iso = _grid(spark, sf_dir)
    full = target.extract(grid, target.TargetSettings(iso=iso, **SETTINGS))
    return full.where("kind = 'core'").agg(F.count("*").alias("n"), F.round(F.avg(F.col("planarity").cast("double")), 4).alias("mean_planarity"))


def zipped(spark, sf_dir) -> DataFrame:
    """C24: samples and the axes of their surface side by side, refused where they don't match one to one."""
    _, _, samples = _samples(spark, sf_dir)
    _, axes = _normals(spark, sf_dir)
    return target.zipped(samples.select(*KEY, "kind", "value"), axes.select(*KEY, "nx", "ny", "nz"))


def nearest_seed(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    w = g.to_world(grid, *map(F.col, KEY))
    samples = target.core_voxels(grid, iso).select(*KEY, *[c.alias(n) for c, n in zip(w, clouds.WORLD, strict=True)], F.lit("core").alias("kind"))
    return normals.nearest_core(samples, (3.0, 1.5, 12.25)).select(*KEY, r6(F.col("d2")).alias("d2"))


def kernels(spark, sf_dir) -> DataFrame:
    p = _points(spark, sf_dir)
    q = F.abs("wx") * 4
    colors = g.heat_color(q)
    return p.select("pid", r6(g.wendland(q)).alias("wendland"), r6(g.falloff(q, 0.2, 0.5)).alias("falloff"), *[c.alias(n) for c, n in zip(colors, ("red", "green", "blue", "alpha"), strict=True)], g.same_float(q, q + 1e-7).alias("same"))


def edge_costs(spark, sf_dir) -> DataFrame:
    grid, field = _normals(spark, sf_dir)
    samples = field.where("kind = 'core'").select(*KEY, "nx", "ny", "nz", (F.col("value") / 32.0).alias("planarity"))
    found = paths.cost_graph(samples, grid.spacing)
    a, b = target.unpack_key(F.col("u")), target.unpack_key(F.col("v"))
    return found.select(*[c.alias(n) for c, n in zip((*a, *b), ("x", "y", "z", "qx", "qy", "qz"), strict=True)], F.round("cost", 4).alias("cost"))


def _unit_graph(spark, sf_dir):
    grid, iso = _grid(spark, sf_dir)
    core = cut(target.core_voxels(grid, iso).select(*KEY))
    flat = core.select(*KEY, F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0.0).alias("planarity"))
    return core, cut(paths.cost_graph(flat, grid.spacing).select("u", "v", F.round("cost", 6).alias("cost")))


def distances(spark, sf_dir) -> DataFrame:
    core, links = _unit_graph(spark, sf_dir)
    sources = core.where("x = 5").select(target.pack_key(*map(F.col, KEY)).alias("node"))
    found = paths.sweep(sources, links, 3.0)
    return found.select(*[c.alias(k) for c, k in zip(target.unpack_key(F.col("node")), KEY, strict=True)], r6(F.col("dist")).alias("dist"))


def route(spark, sf_dir) -> DataFrame:
    core, links = _unit_graph(spark, sf_dir)
    first = core.orderBy(*KEY).limit(1).select(target.pack_key(*map(F.col, KEY)).alias("node"))
    swept = paths.sweep(first, links)
    end = swept.orderBy(F.desc("dist"), "node").limit(1).first()
    return paths.route(swept, end and end["node"]).select("seq", *[c.alias(k) for c, k in zip(target.unpack_key(F.col("node")), KEY, strict=True)])


def brush(spark, sf_dir) -> DataFrame:
    grid, field = _normals(spark, sf_dir)
    samples = cut(field.where("kind = 'core'").select(*KEY, "nx", "ny", "nz", F.lit(0.5).alias("planarity")))
    line = samples.where("x = 5 AND y = 5").select(*KEY)
    return paths.brush(samples, line, grid.spacing, 0.5, 1.0)


def radius_planarity(spark, sf_dir) -> DataFrame:
    """B11: planarity of all surface places within a radius, the place itself counted."""
    grid, iso = _grid(spark, sf_dir)
    found = tiles.skin(grid, iso, RADIUS_MM, math.radians(15))
    return found.select(*KEY, *[(F.round(F.col(c).cast("float").cast("double"), 4) + F.lit(0.0)).alias(c) for c in ("deviation", "planarity")])


def _painted(spark, sf_dir) -> DataFrame:
    """The samples of a whole stroke of three points over the line item volume."""
    grid, iso = _grid(spark, sf_dir)
    path = spark.range(3).select(F.col("id").alias("seq"), (F.col("id") * 2.0 + 1.0).alias("wx"), (F.col("id") * 0.5 + 0.7).alias("wy"), (F.col("id") * 3.0 + 12.0).alias("wz"))
    return paths.stroke(grid, path, paths.BrushSettings(0.5, 1.0, 2.0, iso, RADIUS_MM, search=1.5))[0]


def brush_stroke(spark, sf_dir) -> DataFrame:
    """G8, H16."""
    return _painted(spark, sf_dir).select(*KEY, *[r6(F.col(c)).alias(c) for c in ("planarity", "dist", "weight")])


def brush_planarity(spark, sf_dir) -> DataFrame:
    """D24: the mean planarity of what a stroke has painted."""
    return paths.mean_planarity(_painted(spark, sf_dir)).select("n", r6(F.col("mean_planarity")).alias("mean_planarity"))


def _strokes(spark, sf_dir) -> DataFrame:
    return strokes.stroke_events(v.table(spark, sf_dir, "events"))


def stroke_totals(spark, sf_dir) -> DataFrame:
    return strokes.totals(_strokes(spark, sf_dir)).select("stroke_id", "points", F.round("length", 4).alias("length"), F.round("seconds", 3).alias("seconds"))


def changed_events(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return strokes.changed_only(e, "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


def growing_slices(spark, sf_dir) -> DataFrame:
    fits = _strokes(spark, sf_dir).select("stroke_id", "seq", F.floor(F.col("seq") * 3 / 4).cast("long").alias("count"))
    return strokes.growing_slices(fits, "stroke_id", "seq", "count")


def spaced(spark, sf_dir) -> DataFrame:
    return strokes.spaced(_strokes(spark, sf_dir), 20.0)


def _weights(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).cast("int").alias("x"), (F.col("event_id") % 7).cast("int").alias("y"), F.lit(0).alias("z"), (F.round(F.col("value"), 3) - 20).alias("weight"), "event_type")


def merged_weights(spark, sf_dir) -> DataFrame:
    w = _weights(spark, sf_dir)
    return strokes.merge_weights(*[w.where(f"y % 2 = {i}") for i in (0, 1)])


def normalised_weights(spark, sf_dir) -> DataFrame:
    merged = strokes.merge_weights(_weights(spark, sf_dir))
    top = merged.agg(F.max("weight").alias("top"))
    return merged.crossJoin(F.broadcast(top)).select(*KEY, r6(F.col("weight") / F.col("top")).alias("heat"))  # one row


def names(spark, sf_dir) -> DataFrame:
    p = v.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("?"))).when(F.col("p_partkey") % 7 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("name"))
    return p.select("p_partkey", stores.valid_name(F.col("name")).alias("valid"))


def fingerprint(spark, sf_dir) -> DataFrame:
    found = stores.fingerprint(v.from_lineitem(spark, sf_dir), {"iso": 12.0})
    return found.select("grid", "class", "n", "active", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")


def presets(spark, sf_dir) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.to_json(F.struct(F.col("o_orderpriority").alias("name"), (F.col("o_totalprice") / 100).cast("int").alias("core_mm")))).otherwise(F.to_json(F.struct((F.col("o_orderkey") % 3).alias("strength")))).alias("value"))
    return stores.presets(o).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("core_mm"), 2).alias("core_mm"), F.round(F.sum("strength"), 2).alias("strength"), F.max("falloff_mm").alias("falloff_mm"))


def windows(spark, sf_dir) -> DataFrame:
    e = v.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


#: Radius of planarity in the queries, in mm.
RADIUS_MM = 1.2

QUERIES = {
    "c12_radius_join": within_radius, "c12_radius_join_all": within_radius, "c15_core_at": lookups, "d20_voxel_areas": voxel_areas, "d24_mean_planarity": mean_planarity, "c24_zipped": zipped, "e2_nearest_k": nearest_k, "d7_b15_kernel_means": kernel_means, "d8_quadratic_sums": quadratic_sums, "b21_quadratic_fit": quadratic_fit,
    "c13_e13_nearest_sample": nearest_sample, "c13_e13_nearest_sample_all": nearest_sample, "c14_nearest_seed": nearest_seed, "b16_b27_b29_kernels": kernels, "b17_edge_costs": edge_costs, "g7_distances": distances,
    "g6_route": route, "g8_brush": brush, "b11_radius_planarity": radius_planarity, "g8_h16_stroke": brush_stroke, "d24_brush_planarity": brush_planarity, "d26_stroke_totals": stroke_totals, "e11_changed_events": changed_events, "e8_e9_growing_slices": growing_slices, "e10_spaced": spaced,
    "d16_merged_weights": merged_weights, "d27_normalised_weights": normalised_weights, "a14_names": names, "a10_fingerprint": fingerprint, "a19_presets": presets, "i_event_windows": windows,
}

PTS = """pts AS MATERIALIZED (SELECT vec_id AS pid, embedding[1]::DOUBLE AS wx, embedding[2]::DOUBLE AS wy, embedding[3]::DOUBLE AS wz, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings)"""
D2 = "(q.wx - p.wx)*(q.wx - p.wx) + (q.wy - p.wy)*(q.wy - p.wy) + (q.wz - p.wz)*(q.wz - p.wz)"
STROKES = """strokes AS (SELECT user_id AS stroke_id, row_number() OVER w AS seq, (epoch_us(ts) / 1000.0 - first_value(epoch_us(ts)) OVER w / 1000.0)::DOUBLE AS ms, value % 97 AS wx, (event_id % 53) / 10.0 AS wy
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_FAR = "((s.wx - k.lx) * (s.wx - k.lx) + (s.wy - k.ly) * (s.wy - k.ly) >= 400)"
_WEN = "(CASE WHEN {q} < 1 THEN pow(1 - {q}, 4) * (4 * {q} + 1) ELSE 0 END)"
GRAPH = f"""link AS MATERIALIZED (SELECT a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS qz, round(sqrt(o.dx*o.dx*{SX}*{SX} + o.dy*o.dy*{SY}*{SY} + o.dz*o.dz)::DOUBLE, 6) AS cost
  FROM core a CROSS JOIN box26 o JOIN core b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
walk(x, y, z, dist) AS (
  SELECT x, y, z, 0::DOUBLE FROM core WHERE x = 5
  UNION SELECT l.qx, l.qy, l.qz, min(round(w.dist + l.cost, 6)) FROM walk w JOIN link l USING (x, y, z) WHERE round(w.dist + l.cost, 6) < 3 GROUP BY ALL)"""
W = "w AS (SELECT CAST(user_id % 20 AS INTEGER) AS x, CAST(event_id % 7 AS INTEGER) AS y, 0 AS z, round(value, 3) - 20 AS weight FROM events), m AS (SELECT x, y, z, max(weight) AS weight FROM w WHERE weight > 0 GROUP BY ALL)"
_BALL = [o for o in box(4, center=True) if (o[0] ** 2 * SX * SX + o[1] ** 2 * SY * SY + o[2] ** 2 * SZ * SZ) <= RADIUS_MM**2]
_CENTRAL = ", ".join(f"({_at(*p)} - {_at(*m)}) * 0.5 * ({-1.0 / s!r})::DOUBLE AS g{k}" for k, s, p, m in (("x", SX, (1, 0, 0), (-1, 0, 0)), ("y", SY, (0, 1, 0), (0, -1, 0)), ("z", SZ, (0, 0, 1), (0, 0, -1))))
SKIN = f"""grad AS MATERIALIZED (SELECT c.x, c.y, c.z, {_CENTRAL} FROM core c),
skin AS MATERIALIZED (SELECT x, y, z, {", ".join(f"{_unit('gx', 'gy', 'gz', f'g{k}')} AS n{k}" for k in "xyz")} FROM grad),
near AS (SELECT c.x, c.y, c.z, exp(-(o.dx*o.dx*{SX}*{SX} + o.dy*o.dy*{SY}*{SY} + o.dz*o.dz) * {0.5 / (RADIUS_MM / 2) ** 2!r}::DOUBLE) AS w, CASE WHEN c.nx*n.nx + c.ny*n.ny + c.nz*n.nz < 0 THEN -1 ELSE 1 END AS side, n.nx, n.ny, n.nz
  FROM skin c CROSS JOIN ball o JOIN skin n ON n.x = c.x + o.dx AND n.y = c.y + o.dy AND n.z = c.z + o.dz WHERE n.nx*n.nx + n.ny*n.ny + n.nz*n.nz > 1e-20),
tot AS (SELECT x, y, z, sum(w) AS w, sum(side * w * nx) AS s0, sum(side * w * ny) AS s1, sum(side * w * nz) AS s2 FROM near GROUP BY ALL),
flat AS (SELECT x, y, z, coalesce(t.w, 0) AS w, sqrt(-2 * ln(CASE WHEN t.w > 0 THEN least(greatest(sqrt(s0*s0 + s1*s1 + s2*s2) / t.w, 1e-12), 1) ELSE 1e-12 END)) AS d FROM skin LEFT JOIN tot t USING (x, y, z))"""

SQL = {
    "b11_radius_planarity": _with(VOX, SIX, CORE, _values(_BALL, "ball"), SKIN) + " SELECT x, y, z, round(CAST(CAST(d AS REAL) AS DOUBLE), 4) + 0.0 AS deviation, round(CAST(CAST((1 - exp(-w / 3.0)) * exp(-(d / radians(15.0)) * (d / radians(15.0))) AS REAL) AS DOUBLE), 4) + 0.0 AS planarity FROM flat",
    "c12_radius_join": f"WITH {PTS} SELECT q.pid, p.pid AS p_pid, round({D2}, 6) + 0.0 AS d2 FROM pts q, pts p WHERE {D2} <= {RADIUS ** 2!r}",
    "c15_core_at": _with(VOX, SIX, CORE) + " SELECT o_orderkey AS pid, c.x, c.y, c.z, c.value, c.crossings FROM orders JOIN core c ON c.x = o_orderkey % 30 AND c.y = o_custkey % 12 AND c.z = o_orderkey % 35",
    "d20_voxel_areas": _with(*ALL_SAMPLES, NORMALS, ROUNDED) + f" SELECT x, y, z, round(({SX * SY * SZ!r})::DOUBLE / (abs(nx) * {SX} + abs(ny) * {SY} + abs(nz) * {SZ}), 5) AS m2 FROM field WHERE kind = 'core' AND (nx <> 0 OR ny <> 0 OR nz <> 0)",
    "d24_mean_planarity": _with(*ALL_SAMPLES, NORMALS, BOX, PLANAR) + " SELECT count(*) AS n, round(avg(CAST(CAST(CASE WHEN good THEN (1 - exp(-w / 3.0)) * exp(-(d / radians(15.0)) * (d / radians(15.0))) ELSE 0 END AS REAL) AS DOUBLE)), 4) AS mean_planarity FROM dev",
    "c24_zipped": _with(*ALL_SAMPLES, NORMALS, ROUNDED) + " SELECT x, y, z, s.kind, s.value, nx, ny, nz FROM samples s JOIN field f USING (x, y, z)",
    "b17_edge_costs": _with(*ALL_SAMPLES, NORMALS, ROUNDED, BOX) + f""", s AS MATERIALIZED (SELECT x, y, z, nx, ny, nz, core.value / 32.0::DOUBLE AS p FROM field JOIN core USING (x, y, z) WHERE kind = 'core'),
      e AS (SELECT a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS qz, o.dx * {SX}::DOUBLE AS ex, o.dy * {SY}::DOUBLE AS ey, o.dz * {SZ}::DOUBLE AS ez, sqrt(a.p * b.p) AS p, acos(least(greatest(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz, -1), 1)) / radians(20.0) AS turn,
              a.nx, a.ny, a.nz, a.nx + b.nx AS mx, a.ny + b.ny AS my, a.nz + b.nz AS mz FROM s a CROSS JOIN box26 o JOIN s b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
      f AS (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS size, sqrt(mx*mx + my*my + mz*mz) AS ml FROM e),
      h AS (SELECT *, abs(CASE WHEN ml * ml <= 1e-20 THEN ex*nx + ey*ny + ez*nz ELSE (ex*mx + ey*my + ez*mz) / ml END) / size AS off FROM f)
      SELECT x, y, z, qx, qy, qz, round(size * (1 + p * (16 * off * off + 0.5 * turn * turn)), 4) AS cost FROM h""",
    "e2_nearest_k": f"WITH {PTS}, r AS (SELECT q.pid, p.pid AS p_pid, {D2} AS d2, CAST(row_number() OVER (PARTITION BY q.pid ORDER BY {D2}, p.pid) AS INTEGER) AS rank FROM pts q, pts p WHERE q.pid <> p.pid AND {D2} <= {RADIUS ** 2!r}) SELECT pid, p_pid, rank, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank <= 4",
    "d7_b15_kernel_means": f"""WITH {PTS}, u AS MATERIALIZED (SELECT pid, wx, wy, wz, a / l AS nx, b / l AS ny, c / l AS nz FROM (SELECT *, sqrt(a*a + b*b + c*c) AS l FROM pts)),
      k AS (SELECT q.pid, p.wx, p.wy, p.wz, q.nx*p.nx + q.ny*p.ny + q.nz*p.nz AS d, sqrt({D2}) / {RADIUS}::DOUBLE AS s FROM u q, u p WHERE {D2} <= {RADIUS ** 2!r}),
      t AS (SELECT pid, wx, wy, wz, {_WEN.format(q='s')} * d AS w FROM k WHERE d >= 0.25)
      SELECT pid, count(*) AS n, round(sum(w), 6) + 0.0 AS weight, round(sum(w * wx) / sum(w), 6) + 0.0 AS ax, round(sum(w * wy) / sum(w), 6) + 0.0 AS ay, round(sum(w * wz) / sum(w), 6) + 0.0 AS az FROM t GROUP BY pid""",
    "d8_quadratic_sums": f"""WITH {PTS}, k AS (SELECT q.pid, p.wx - q.wx AS u, p.wy - q.wy AS v, p.wz - q.wz AS h, sqrt({D2}) / 0.2::DOUBLE AS s FROM pts q, pts p WHERE {D2} <= {0.2 ** 2!r}), t AS (SELECT *, {_WEN.format(q='s')} AS w FROM k)
      SELECT pid, count(*) AS n, round(sum(w), 6) + 0.0 AS w, round(sum(w), 6) + 0.0 AS m00, round(sum(w*u*v), 6) + 0.0 AS m12, round(sum(w*u*u*u*u), 6) + 0.0 AS m33, round(sum(w*v*v*v*v), 6) + 0.0 AS m55, round(sum(w*h), 6) + 0.0 AS r0, round(sum(w*u*u*h), 6) + 0.0 AS r3 FROM t GROUP BY pid""",
    "c13_e13_nearest_sample": _with(VOX, SIX, CORE) + f""", r AS (
        SELECT q.x, q.y, q.z, p.x AS core_x, p.y AS core_y, p.z AS core_z, ((p.x - q.x) * {SX}::DOUBLE - 0.01)**2 + ((p.y - q.y) * {SY}::DOUBLE - 0.02)**2 + ((p.z - q.z) * {SZ}::DOUBLE - 0.03)**2 AS d2
        FROM vox q JOIN core p ON p.x BETWEEN q.x - 4 AND q.x + 4 AND p.y BETWEEN q.y - 4 AND q.y + 4 AND p.z BETWEEN q.z - 4 AND q.z + 4)
      SELECT x, y, z, core_x, core_y, core_z, round(d2, 6) + 0.0 AS d2 FROM r QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY round(d2, 9), core_x, core_y, core_z) = 1""",
    "c14_nearest_seed": _with(VOX, SIX, CORE) + f" SELECT x, y, z, round((x*{SX}::DOUBLE - 3)**2 + (y*{SY}::DOUBLE - 1.5)**2 + (z*{SZ}::DOUBLE - 12.25)**2, 6) + 0.0 AS d2 FROM core ORDER BY (x*{SX}::DOUBLE - 3)**2 + (y*{SY}::DOUBLE - 1.5)**2 + (z*{SZ}::DOUBLE - 12.25)**2, x, y, z LIMIT 1",
    "b16_b27_b29_kernels": f"""WITH {PTS}, k AS (SELECT pid, abs(wx) * 4 AS q, least(greatest(abs(wx) * 4, 0), 1) AS h, least(greatest((abs(wx) * 4 - 0.2) / 0.5, 0), 1) AS t FROM pts)
      SELECT pid, round({_WEN.format(q='q')}, 6) + 0.0 AS wendland, round(CASE WHEN q <= 0.2 THEN 1 ELSE 1 - t*t*t*(t*(t*6 - 15) + 10) END, 6) + 0.0 AS falloff,
             CAST(CASE WHEN q > 0 THEN floor(least(greatest(2*h, 0), 1) * 255 + 0.5) ELSE 0 END AS INTEGER) AS red, CAST(CASE WHEN q > 0 THEN floor(least(greatest(2 - abs(4*h - 2), 0), 1) * 255 + 0.5) ELSE 0 END AS INTEGER) AS green,
             CAST(CASE WHEN q > 0 THEN floor(least(greatest(2*(1 - h), 0), 1) * 255 + 0.5) ELSE 0 END AS INTEGER) AS blue, CAST(CASE WHEN q > 0 THEN floor((0.55 + 0.45*h) * 255 + 0.5) ELSE 0 END AS INTEGER) AS alpha, true AS same FROM k""",
    "g7_distances": _with(VOX, SIX, CORE, BOX, GRAPH) + " SELECT x, y, z, round(min(dist), 6) + 0.0 AS dist FROM walk GROUP BY ALL",
    "d26_stroke_totals": f"""WITH {STROKES}, s AS (SELECT *, coalesce(sqrt((wx - lag(wx) OVER w)**2 + (wy - lag(wy) OVER w)**2), 0) AS step FROM strokes WINDOW w AS (PARTITION BY stroke_id ORDER BY seq))
      SELECT stroke_id, count(*) AS points, round(sum(step), 4) AS length, round(max(ms) / 1000, 3) AS seconds FROM s GROUP BY stroke_id""",
    "e11_changed_events": "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) OR row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "e10_spaced": f"""WITH RECURSIVE {STROKES}, kept(stroke_id, seq, lx, ly, stays) AS (
        SELECT stroke_id, seq, wx, wy, true FROM strokes WHERE seq = 1
        UNION ALL SELECT s.stroke_id, s.seq, CASE WHEN {_FAR} THEN s.wx ELSE k.lx END, CASE WHEN {_FAR} THEN s.wy ELSE k.ly END, {_FAR} FROM kept k JOIN strokes s ON s.stroke_id = k.stroke_id AND s.seq = k.seq + 1)
      SELECT stroke_id, seq, lx AS wx, ly AS wy, 0::DOUBLE AS wz FROM kept WHERE stays""",
    "e8_e9_growing_slices": f"""WITH {STROKES}, f AS (SELECT stroke_id, seq, CAST(floor(seq * 3 / 4.0) AS BIGINT) AS n FROM strokes), g AS (SELECT *, coalesce(lag(n) OVER w, 0) AS b, max(n) OVER w AS top FROM f WINDOW w AS (PARTITION BY stroke_id ORDER BY seq))
      SELECT stroke_id, seq, greatest(b - 1, 0) AS "from", n AS "to", n >= top AS valid FROM g WHERE n <> b""",
    "d16_merged_weights": f"WITH {W} SELECT * FROM m",
    "d27_normalised_weights": f"WITH {W} SELECT x, y, z, round(weight / (SELECT max(weight) FROM m), 6) + 0.0 AS heat FROM m",
    "a14_names": r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '?' WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_name END AS name FROM part)
      SELECT p_partkey, length(trim(name)) > 0 AND NOT regexp_matches(name, '[\x00-\x1F\x7F\\/:*?"<>|]') AS valid FROM p""",
    "a10_fingerprint": _with(VOX) + " SELECT 'density' AS grid, 'fog' AS class, count(*) AS n, count(*) AS active, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM vox",
    "a19_presets": """WITH o AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE 'preset' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN least(greatest(CAST(trunc(o_totalprice / 100) AS DOUBLE), 0.1), 1000) ELSE 5 END AS core_mm,
        CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE least(o_orderkey % 3, 1) END AS strength FROM orders)
      SELECT name, count(*) AS n, round(sum(core_mm), 2) AS core_mm, round(CAST(sum(strength) AS DOUBLE), 2) AS strength, CAST(10 AS DOUBLE) AS falloff_mm FROM o GROUP BY name""",
    "i_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
SQL |= {f"{k}_all": SQL[k] for k in ("c12_radius_join", "c13_e13_nearest_sample")}
