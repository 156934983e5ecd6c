"""Reconstruction: Newton probes onto an iso surface, moving least squares fields, and projected meshes.

Every step works on all points at once: a radius join and grouped sums for the fit, one lookup of cell corners for all
candidate positions of a line search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import clouds, mesh, target
from isovane.operators.stencil import KEY, box, neighbours, radius_join
from isovane.plans.lineage import cut
from isovane.sources.voxels import FOG, Grid

W = clouds.WORLD


@dataclass(frozen=True)
class MlsSettings:
    iso: float = 255.0
    radius: float = 0.005
    most: int = 96
    ridge: float = 1e-6
    transition_weight: float = 0.05
    density_share: float = 0.75
    rounds: int = 2
    max_move: float = 0.002
    least_dot: float = 0.25


def _sampled(grid: Grid, points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, wx, wy, wz) with the trilinear value at their world positions."""
    at = g.to_index(grid, *map(F.col, W))
    moved = points.select(*points.columns, *[c.alias(p) for c, p in zip(at, ("px", "py", "pz"), strict=True)])
    return target.trilinear(grid, moved).select(*points.columns, F.col("sampled"))


def probe(grid: Grid, points: DataFrame, iso: float, rounds: int = 8, tolerance: float = 0.1, max_step: float = 0.0) -> DataFrame:
    """(pid, wx, wy, wz, x, y, z, nx, ny, nz, value, residual, converged, moved): points projected onto the surface.

    Newton steps along central differences half a voxel wide, clamped to ``max_step`` (0: two voxels), halved up to four
    times while the residual grows. A point that doesn't converge is reported where it began, with its residual there.
    """
    if rounds < 1 or tolerance <= 0 or max_step < 0:
        raise ValueError("rounds and tolerance must be positive, the step not negative")
    step = [max(abs(s) * 0.5, 1e-9) for s in grid.spacing]
    longest = max_step or 2.0 * max(map(abs, grid.spacing))
    sides = [(0, 0, 0), *[tuple(s if i == a else 0 for i in range(3)) for a in range(3) for s in (1, -1)]]
    start = points.select("pid", *W)
    state = cut(start.select("pid", *W, *[F.lit(0.0).alias(n) for n in ("nx", "ny", "nz", "value")], F.lit(False).alias("converged"), F.lit(True).alias("going")))
    for n in range(rounds + 1):
        going = state.where("going")
        if going.isEmpty():
            break
        star = F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col(w) + F.lit(o * h)).alias(w) for w, o, h in zip(W, side, step, strict=True)]) for i, side in enumerate(sides)])
        around = _sampled(grid, going.select("pid", F.explode(star).alias("s")).select("pid", "s.i", *[f"s.{w}" for w in W]), ["pid", "i"])
        wide = around.groupBy("pid").agg(*[F.max(F.when(F.col("i") == i, F.col("sampled"))).alias(f"f{i}") for i in range(7)])
        grad = [(F.col(f"f{1 + 2 * a}") - F.col(f"f{2 + 2 * a}")) / (2.0 * step[a]) for a in range(3)]
        known = cut(going.join(wide, "pid").select("pid", *W, "nx", "ny", "nz", *[c.alias(k) for c, k in zip(grad, ("gx", "gy", "gz"), strict=True)], F.col("f0").alias("value"), (F.col("f0") - iso).alias("residual")))
        gradient = g.vector("gx", "gy", "gz")
        outward = g.normalized(tuple(c * grid.outward() for c in gradient))
        steep = g.dot(gradient, gradient)
        there = F.abs("residual") <= tolerance
        stopped = known.where(there | (steep <= g.TINY) | F.lit(n == rounds)).select("pid", *W, *[F.when(there & (steep > g.TINY), c).otherwise(F.col(o)).alias(o) for c, o in zip(outward, ("nx", "ny", "nz"), strict=True)], "value", there.alias("converged"), F.lit(False).alias("going"))
        size = F.sqrt(steep)
        whole = F.abs("residual") / size
        scale = F.least(whole, F.lit(longest)) * F.signum("residual") / size
        tries = F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(w) - c * scale * (0.5**k)).alias(w) for w, c in zip(W, gradient, strict=True)]) for k in range(5)])
        moving = known.where(~there & (steep > g.TINY)) if n < rounds else known.where("false")
        offered = moving.select("pid", F.col("residual").alias("old"), F.explode(tries).alias("s"), *[c.alias(o) for c, o in zip(outward, ("ox", "oy", "oz"), strict=True)])
        tried = _sampled(grid, offered.select("pid", "old", "ox", "oy", "oz", "s.k", *[f"s.{w}" for w in W]), ["pid", "k"])
        better = (F.abs(F.col("sampled") - iso) <= F.abs("old")) | (F.col("k") == 4)
        chosen = tried.where(better).groupBy("pid").agg(F.min(F.struct("k", *W, "ox", "oy", "oz", "sampled")).alias("m"))
        moved = chosen.select("pid", *[f"m.{w}" for w in W], F.col("m.ox").alias("nx"), F.col("m.oy").alias("ny"), F.col("m.oz").alias("nz"), F.col("m.sampled").alias("value"), F.lit(False).alias("converged"), F.lit(True).alias("going"))
        state = cut(state.where("NOT going").unionByName(stopped).unionByName(moved))
    began = _sampled(grid, start, ["pid"]).select("pid", *[F.col(w).alias(f"b_{w}") for w in W], F.col("sampled").alias("b_value"))
    both = state.join(began, "pid")
    ok = F.col("converged")
    final = both.select("pid", *[F.when(ok, F.col(w)).otherwise(F.col(f"b_{w}")).alias(w) for w in W], "nx", "ny", "nz", F.when(ok, F.col("value")).otherwise(F.col("b_value")).alias("value"), "converged", *[f"b_{w}" for w in W])
    index = [g.nearest(c).alias(k) for c, k in zip(g.to_index(grid, *map(F.col, W)), KEY, strict=True)]
    far = g.length(g.minus(g.vector(*W), g.vector(*[f"b_{w}" for w in W])))
    return final.select("pid", *W, *index, "nx", "ny", "nz", "value", (F.col("value") - iso).alias("residual"), "converged", far.alias("moved"))


def located(grid: Grid, samples: DataFrame, iso: float) -> DataFrame:
    """(sid, wx, wy, wz, nx, ny, nz, core, support, component) of samples (x, y, z, value, kind, support, nx, ny, nz).

    Core samples lie at the mean of their crossings and belong to their 26-connected component; transitions lie at their
    voxel and belong to the component of the nearest core sample around (equal ones: the first), or to none.
    """
    samples = samples.select(*KEY, "value", "kind", "support", "nx", "ny", "nz")
    core = samples.where("kind = 'core'")
    met = target.crossings(grid, core, iso)
    means = met.groupBy(*KEY).agg(*[F.avg(F.col(d) * F.col("t")).alias(f"o{d}") for d in ("dx", "dy", "dz")])
    offset = [F.coalesce(f"o{d}", F.lit(0.0)) for d in ("dx", "dy", "dz")]
    here = core.join(means, KEY, "left").select(*core.columns, *[c.alias(w) for c, w in zip(g.to_world(grid, *[F.col(k) + o for k, o in zip(KEY, offset, strict=True)]), W, strict=True)])
    placed = cut(here.join(target.components(core), KEY))
    outer = samples.where("kind <> 'core'")
    outer = outer.select(*outer.columns, *[c.alias(w) for c, w in zip(g.to_world(grid, *map(F.col, KEY)), W, strict=True)])
    near = neighbours(outer.select(*KEY, *W), placed.select(*KEY, *W, "component"), box(1, center=True))
    d2 = sum((F.col(w) - F.col(f"n_{w}")) * (F.col(w) - F.col(f"n_{w}")) for w in W)
    best = near.groupBy(*KEY).agg(F.min(F.struct(d2.alias("d2"), "qx", "qy", "qz", "n_component"))["n_component"].alias("component"))
    rows = placed.unionByName(outer.join(best, KEY, "left"))
    return rows.select(target.pack_key(*map(F.col, KEY)).alias("sid"), *W, "nx", "ny", "nz", (F.col("kind") == "core").alias("core"), F.col("support").cast("double").alias("support"), "component")


def field_at(points: DataFrame, samples: DataFrame, settings: MlsSettings) -> DataFrame:
    """(pid, field, mx, my, mz) for points (pid, wx, wy, wz) with support: signed distance to the fitted surface, its normal.

    The nearest core sample names component and direction; core samples of that component that agree with it give the
    anchor; the nearest ``most`` samples are fitted by a quadratic height over the anchor's plane. Ties: smaller ids.
    """
    r = settings.radius
    useful = samples.where(g.dot(g.vector("nx", "ny", "nz"), g.vector("nx", "ny", "nz")) > g.TINY)
    unit = g.normalized(g.vector("nx", "ny", "nz"))
    source = cut(useful.select("sid", *W, *[c.alias(n) for c, n in zip(unit, ("nx", "ny", "nz"), strict=True)], "core", "support", "component"))
    pairs = cut(radius_join(points.select("pid", *W), source, r))
    n = g.vector("p_nx", "p_ny", "p_nz")
    lead = pairs.where("p_core").groupBy("pid").agg(F.min(F.struct("d2", "p_sid", "p_component", "p_nx", "p_ny", "p_nz")).alias("l")).select("pid", F.col("l.p_component").alias("component"), *[F.col(f"l.p_{c}").alias(f"l{c}") for c in ("nx", "ny", "nz")])
    led = pairs.join(lead, "pid").where(F.col("p_component") == F.col("component"))
    agree = g.dot(n, g.vector("lnx", "lny", "lnz"))
    weight = g.wendland(F.sqrt("d2") / r) * agree
    kept = led.where(F.col("p_core") & (agree >= settings.least_dot)).withColumn("w", weight)
    sums = kept.groupBy("pid").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"p_{c}")).alias(f"s{c}") for c in (*W, "nx", "ny", "nz")], F.first("component").alias("component"))
    axis = g.normalized(g.vector("snx", "sny", "snz"))
    anchored = cut(sums.where(F.col("w") > 1e-12).select("pid", "component", *[(F.col(f"s{c}") / F.col("w")).alias(a) for c, a in zip(W, ("ax", "ay", "az"), strict=True)], *[c.alias(a) for c, a in zip(axis, ("hx", "hy", "hz"), strict=True)]).where("hx <> 0 OR hy <> 0 OR hz <> 0"))
    h = g.vector("hx", "hy", "hz")
    flat = F.abs("hx") < 0.9
    side = tuple(F.when(flat, F.lit(a)).otherwise(F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))
    u = g.normalized(g.cross(h, side))
    planes = anchored.select(*anchored.columns, *[c.alias(k) for c, k in zip(u, ("ux", "uy", "uz"), strict=True)])
    v = g.cross(h, g.vector("ux", "uy", "uz"))
    planes = cut(planes.select(*planes.columns, *[c.alias(k) for c, k in zip(v, ("vx", "vy", "vz"), strict=True)]))
    fitted = clouds.nearest(pairs, "pid", "p_sid", settings.most).join(planes, "pid").where(F.col("p_component") == F.col("component"))
    turn = g.dot(n, h)
    confidence = F.when(F.col("p_core"), F.lit(1.0)).otherwise(g.clamp(F.col("p_support") * settings.transition_weight, 0, 1))
    delta = g.minus(g.vector(*[f"p_{w}" for w in W]), g.vector("ax", "ay", "az"))
    across = lambda d, k: g.dot(d, g.vector(f"{k}x", f"{k}y", f"{k}z"))
    rows = fitted.where(turn >= settings.least_dot).select("pid", (g.wendland(F.sqrt("d2") / r) * confidence * turn).alias("w"), (across(delta, "u") / r).alias("u"), (across(delta, "v") / r).alias("v"), F.when(F.col("p_core"), across(delta, "h") / r).otherwise(F.lit(0.0)).alias("t"))
    solved = clouds.solve_quadratic(clouds.quadratic_sums(rows.where("w > 1e-10"), "pid", F.col("u"), F.col("v"), F.col("t"), F.col("w")), "pid", settings.ridge).where("q0 IS NOT NULL")
    full = solved.join(planes, "pid").join(points.select("pid", *W), "pid")
    rel = g.minus(g.vector(*W), g.vector("ax", "ay", "az"))
    at = full.select("*", (across(rel, "u") / r).alias("qu"), (across(rel, "v") / r).alias("qv"), across(rel, "h").alias("qh"))
    qu, qv = F.col("qu"), F.col("qv")
    height = F.col("q1") * qu + F.col("q2") * qv + F.col("q3") * qu * qu + F.col("q4") * qu * qv + F.col("q5") * qv * qv
    du, dv = F.col("q1") + 2.0 * F.col("q3") * qu + F.col("q4") * qv, F.col("q2") + F.col("q4") * qu + 2.0 * F.col("q5") * qv
    normal = tuple(a - b * du - c * dv for a, b, c in zip(h, g.vector("ux", "uy", "uz"), g.vector("vx", "vy", "vz"), strict=True))
    return at.select("pid", (F.col("qh") - r * height).alias("field"), *[c.alias(k) for c, k in zip(g.normalized(normal), ("mx", "my", "mz"), strict=True)])


def project(grid: Grid, points: DataFrame, samples: DataFrame, settings: MlsSettings) -> DataFrame:
    """(pid, wx, wy, wz, projected, rejected, density_rejected, moved): points moved onto the fitted surface.

    ``rounds`` steps, each and all together no longer than ``max_move``; in fog a step is halved up to five times until
    the density stays above its share of ``iso``.
    """
    longest = min(settings.radius, settings.max_move / max(1, settings.rounds))
    false = F.lit(False)
    state = cut(points.select("pid", *W, *[F.col(w).alias(f"b_{w}") for w in W], *[false.alias(k) for k in ("projected", "rejected", "density_rejected")], F.lit(True).alias("going")))
    for _ in range(settings.rounds):
        going = state.where("going")
        fields = cut(field_at(going.select("pid", *W), samples, settings))
        known = going.join(fields, "pid", "left")
        gone = g.length(g.minus(g.vector(*W), g.vector(*[f"b_{w}" for w in W])))
        room = F.lit(settings.max_move) - gone
        size = F.least(F.abs(g.clamp(F.col("field"), -settings.radius, settings.radius)), F.lit(longest), room)
        known = cut(known.select("*", size.alias("size"), room.alias("room")))
        missing, still = F.col("field").isNull(), F.abs("field") <= 1e-9
        stuck = missing | (~still & (F.col("room") <= 1e-12))
        kept = [c for c in state.columns if c not in ("projected", "rejected", "going")]
        ended = known.where(stuck | still).select(*kept, (F.col("projected") | ~stuck).alias("projected"), (F.col("rejected") | stuck).alias("rejected"), false.alias("going"))
        moving = known.where(~stuck & ~still)
        tries = F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(w) - F.signum("field") * F.col("size") * F.col(m) * (0.5**k)).alias(w) for w, m in zip(W, ("mx", "my", "mz"), strict=True)]) for k in range(6)])
        tried = _sampled(grid, moving.select("pid", F.explode(tries).alias("s")).select("pid", "s.k", *[f"s.{w}" for w in W]), ["pid", "k"])
        safe = F.col("sampled") >= settings.iso * settings.density_share if grid.grid_class == FOG else F.lit(True)
        chosen = tried.where(safe).groupBy("pid").agg(F.min(F.struct("k", *W)).alias("m"))
        after = moving.join(chosen, "pid", "left")
        ok = F.col("m").isNotNull()
        stepped = after.select("pid", *[F.when(ok, F.col(f"m.{w}")).otherwise(F.col(w)).alias(w) for w in W], *[f"b_{w}" for w in W], (F.col("density_rejected") | ~ok).alias("density_rejected"), (F.col("projected") | ok).alias("projected"), (F.col("rejected") | ~ok).alias("rejected"), ok.alias("going"))
        state = cut(state.where("NOT going").unionByName(ended).unionByName(stepped))
    far = g.length(g.minus(g.vector(*W), g.vector(*[f"b_{w}" for w in W])))
    return state.select("pid", *W, "projected", "rejected", "density_rejected", far.alias("moved"))


def reconstruct(grid: Grid, samples: DataFrame, settings: MlsSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices with normals, triangles, outcome): the largest mesh component, its vertices projected onto the fitted samples.

    ``samples`` have x, y, z, value, kind, support, nx, ny, nz. The topology stays that of the iso surface. ``outcome`` is one
    row: how many vertices were not projected, rejected, or held back by density, and the farthest move.
    """
    vertices, triangles = (cut(t) for t in mesh.surface_net(grid, settings.iso))
    kept = mesh.split(triangles, vertices).where("primary").drop("primary")
    vertices, triangles = (cut(t) for t in mesh.compact(kept, vertices))
    points = vertices.select(F.col("vid").alias("pid"), *[F.col(p).alias(w) for p, w in zip(("px", "py", "pz"), W, strict=True)])
    moved = cut(project(grid, points, cut(located(grid, samples, settings.iso)), settings))
    placed = moved.select(F.col("pid").alias("vid"), *[F.col(w).alias(p) for p, w in zip(("px", "py", "pz"), W, strict=True)])
    return mesh.vertex_normals(triangles, placed), triangles, outcome(moved)


def outcome(moved: DataFrame) -> DataFrame:
    return moved.agg(F.count("*").alias("vertices"), F.count_if(~F.col("projected")).alias("fallback"), F.count_if("rejected").alias("rejected"), F.count_if("density_rejected").alias("density_rejected"), F.max("moved").alias("farthest"))


def segment_box_d2(df: DataFrame, keys: list[str], a: g.Vector, b: g.Vector, low: g.Vector, high: g.Vector) -> DataFrame:
    """(keys, d2): squared distance from a segment to a box, exactly, for each row of ``df`` (``keys`` identify it).

    Along the segment the distance is a convex, piecewise quadratic function that changes its form only where a coordinate
    passes a side of the box; each piece (seven rows) has its least value at an end or where its derivative vanishes.
    """
    axes = "xyz"
    side = g.minus(b, a)
    named = [c.alias(f"{n}{k}") for n, v in (("o", a), ("s", side), ("l", low), ("h", high)) for c, k in zip(v, axes, strict=True)]
    o, s, lo, hi = ([F.col(f"{n}{k}") for k in axes] for n in "oslh")
    marks = [F.lit(0.0), F.lit(1.0)] + [F.when(d != 0, g.clamp((m - p) / d, 0, 1)).otherwise(F.lit(0.0)) for p, d, x, y in zip(o, s, lo, hi, strict=True) for m in (x, y)]
    sorted_marks = df.select(*keys, *named).withColumn("ts", F.array_sort(F.array(*marks)))
    pieces = sorted_marks.select("*", F.explode(F.arrays_zip(F.slice("ts", 1, 7).alias("t0"), F.slice("ts", 2, 7).alias("t1"))).alias("p")).select(*keys, *[f"{n}{k}" for n in "oslh" for k in axes], "p.t0", "p.t1")
    mid = (F.col("t0") + F.col("t1")) / 2
    gaps = [F.when(p + d * mid < x, p - x).when(p + d * mid > y, p - y) for p, d, x, y in zip(o, s, lo, hi, strict=True)]
    bent = pieces.select("*", sum(F.coalesce(c * d, F.lit(0.0)) for c, d in zip(gaps, s, strict=True)).alias("slope"), sum(F.when(c.isNotNull(), d * d).otherwise(F.lit(0.0)) for c, d in zip(gaps, s, strict=True)).alias("bend"))
    best = F.when(F.col("bend") > 0, F.least(F.greatest(-F.col("slope") / F.col("bend"), F.col("t0")), F.col("t1"))).otherwise(F.col("t0"))
    placed = bent.select("*", F.explode(F.array(best, F.col("t0"), F.col("t1"))).alias("t"))
    off = [F.greatest(x - (p + d * F.col("t")), (p + d * F.col("t")) - y, F.lit(0.0)) for p, d, x, y in zip(o, s, lo, hi, strict=True)]
    return placed.groupBy(*keys).agg(F.min(sum(c * c for c in off)).alias("d2"))


def capsule_leaves(leaves: DataFrame, grid: Grid, a: tuple[float, float, float], b: tuple[float, float, float], radius: float) -> DataFrame:
    """Leaves (bi, bj, bk) within ``radius`` of a segment; a box filter on their keys comes before the exact distance."""
    size = [8 * s for s in grid.spacing]
    keep = F.lit(True)
    for k, s, o, p, q in zip(("bi", "bj", "bk"), size, grid.origin, a, b, strict=True):
        keep = keep & F.col(k).between(int((min(p, q) - radius - o) // s) - 1, int((max(p, q) + radius - o) // s) + 1)
    low = tuple(F.lit(o) + F.col(k) * F.lit(s) for k, s, o in zip(("bi", "bj", "bk"), size, grid.origin, strict=True))
    high = tuple(lo + F.lit(7 * s) for lo, s in zip(low, grid.spacing, strict=True))
    ends = [tuple(F.lit(float(c)) for c in p) for p in (a, b)]
    return segment_box_d2(leaves.where(keep), ["bi", "bj", "bk"], *ends, low, high).where(F.col("d2") <= radius * radius)


def capsule_table(leaves: DataFrame, grid: Grid, capsules: DataFrame, most: int | None = None) -> DataFrame:
    """(sid, bi, bj, bk, d2): the leaves that the capsules of each path touch, each once, with the least squared distance.

    capsules: sid (a path; its capsules are united), ax, ay, az, bx, by, bz, radius; ends may be equal (a ball). Rows with a null or
    non-finite number or a negative radius are no capsules. A path that touches more than ``most`` leaves raises ValueError.

    Capsules are binned by resolution: the cell of a capsule is at least its radius and a leaf, in powers of two, and long ones are
    cut into pieces of a cell, so that a piece meets a few cells whatever its size; a leaf has one row for each
    resolution in use. What shares a cell is compared by boxes, and once for each capsule exactly, with the whole segment.
    """
    size, axes = [8 * s for s in grid.spacing], "xyz"
    unit = float(max(size))
    numbers = [F.col(f"{n}{k}").cast("double") for n in "ab" for k in axes] + [F.col("radius").cast("double")]
    finite = F.lit(True)
    for c in numbers:
        finite = finite & c.isNotNull() & (F.abs(c) < float("inf"))
    named = capsules.where(finite & (F.col("radius") >= 0)).select("sid", *[c.alias(n) for c, n in zip(numbers, [f"{n}{k}" for n in "ab" for k in axes] + ["radius"], strict=True)])
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("radius"), F.lit(unit)) / unit))).cast("int")
    held = cut(named.select(F.monotonically_increasing_id().alias("cid"), "*", level.alias("level")))
    levels = [r.level for r in held.select("level").distinct().collect()]  # powers of two: a thousand at most
    if not levels:
        return leaves.where("false").select(F.lit(None).cast(held.schema["sid"].dataType).alias("sid"), "bi", "bj", "bk", F.lit(0.0).alias("d2"))
    cell = F.pow(F.lit(2.0), F.col("level")) * unit
    length = g.length(g.minus(g.vector("bx", "by", "bz"), g.vector("ax", "ay", "az")))
    cuts = F.greatest(F.lit(1), F.ceil(length / cell)).cast("int")
    pieces = held.withColumn("n", cuts).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for k, s, o in zip(axes, size, grid.origin, strict=True):
        ends = [F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (F.col("i") + j) / F.col("n") for j in (0, 1)]
        pieces = pieces.withColumn(f"l{k}", F.least(*ends) - F.col("radius") - 1e-9 * cell).withColumn(f"h{k}", F.greatest(*ends) + F.col("radius") + 1e-9 * cell)
        pieces = pieces.withColumn(f"c{k}", F.explode(F.sequence(F.floor((F.col(f"l{k}") - s - o) / cell), F.floor((F.col(f"h{k}") - o) / cell))))
    low = {k: F.lit(o) + F.col(b) * F.lit(s) for k, b, s, o in zip(axes, ("bi", "bj", "bk"), size, grid.origin, strict=True)}
    placed = leaves.select("bi", "bj", "bk", F.explode(F.array(*[F.lit(n) for n in sorted(levels)])).alias("level"))
    placed = placed.select("*", *[F.floor((c - o) / cell).alias(f"c{k}") for (k, c), o in zip(low.items(), grid.origin, strict=True)])
    met = pieces.join(placed, ["level", *[f"c{k}" for k in axes]])
    for (k, c), s in zip(low.items(), grid.spacing, strict=True):
        met = met.where((F.col(f"l{k}") <= c + 7 * s) & (F.col(f"h{k}") >= c))
    once = met.select("sid", "cid", "radius", *[f"{n}{k}" for n in "ab" for k in axes], "bi", "bj", "bk").distinct()
    box_low = tuple(low.values())
    box_high = tuple(c + F.lit(7 * s) for c, s in zip(box_low, grid.spacing, strict=True))
    near = segment_box_d2(once, ["sid", "cid", "radius", "bi", "bj", "bk"], g.vector("ax", "ay", "az"), g.vector("bx", "by", "bz"), box_low, box_high).where(F.col("d2") <= F.col("radius") * F.col("radius"))
    found = near.groupBy("sid", "bi", "bj", "bk").agg(F.min("d2").alias("d2"))
    if most is None:
        return found
    found = cut(found)
    if not found.groupBy("sid").agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty():
        raise ValueError(f"a path touches more than {most} leaves")
    return found
