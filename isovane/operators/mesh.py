"""Triangle meshes as vertex and triangle tables: surface nets, topology, normals, components, ray and point queries.

vertex: vid, px, py, pz (and nx, ny, nz); triangle: tid, a, b, c (vertex ids, counter-clockwise from outside).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators.stencil import KEY, SIX, shifted
from isovane.operators.target import pack_key, trilinear
from isovane.operators.tiles import net
from isovane.plans.fixpoint import connected_components
from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered
from isovane.sources.voxels import Grid


def surface_net(grid: Grid, iso: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the surface at ``iso``; needs a background that is outside.

    Every cell of eight voxels with both sides in it gets one vertex, the mean of the crossings on its edges. Every
    voxel edge that crosses becomes a quad of the four cells around it, as two triangles. Vertex ids are packed
    cell coordinates, so triangles need no lookup. Both come out of one pass over tiles.
    """
    if grid.background_inside(iso):
        raise ValueError("the background must be outside")
    rows = cut(net(grid, iso))
    vertex = rows.where("slot < 0")
    index = [F.col(p) for p in ("px", "py", "pz")]
    vertices = vertex.select(pack_key(*map(F.col, KEY)).alias("vid"), *[c.alias(p) for c, p in zip(g.to_world(grid, *index), ("px", "py", "pz"), strict=True)])
    return vertices, _quads(rows.where("slot >= 0").select(*KEY, "slot"))


def _narrow_key(x: Column, y: Column, z: Column) -> Column:
    """Coordinates (within 2^18 of 0) as a long of 57 bits that sorts like (x, y, z)."""
    shift = lambda c: c.cast("long") + F.lit(1 << 18)
    return F.shiftleft(shift(x), 38) + F.shiftleft(shift(y), 19) + shift(z)


def _quads(crossed: DataFrame) -> DataFrame:
    """Two triangles for each crossing (x, y, z, slot): cells around the voxel edge, outward side first."""
    ring = [(0, 0), (-1, 0), (-1, -1), (0, -1)]
    rows = []
    for slot, d in enumerate(SIX):
        axis, sign = slot // 2, sum(d)
        corners = []
        for b, c in ring if sign > 0 else ring[::-1]:
            o = [0, 0, 0]
            o[axis], o[(axis + 1) % 3], o[(axis + 2) % 3] = min(sign, 0), b, c
            corners.append(F.struct(*[F.lit(v).alias(k) for v, k in zip(o, ("i", "j", "k"), strict=True)]))
        rows.append(F.array(*corners))
    cell = lambda n: pack_key(*[F.col(k) + F.get("ring", F.lit(n))[o] for k, o in zip(KEY, ("i", "j", "k"), strict=True)])
    quads = crossed.select(*KEY, "slot", F.get(F.array(*rows), F.col("slot")).alias("ring")).select(*KEY, "slot", *[cell(n).alias(f"q{n}") for n in range(4)])
    first = F.shiftleft(_narrow_key(*map(F.col, KEY)), 4) + F.col("slot") * 2
    halves = F.array(F.struct(first.alias("tid"), F.col("q0").alias("a"), F.col("q1").alias("b"), F.col("q2").alias("c")), F.struct((first + 1).alias("tid"), F.col("q0").alias("a"), F.col("q2").alias("b"), F.col("q3").alias("c")))
    return quads.select(F.explode(halves).alias("t")).select("t.*")


def corners_of(triangles: DataFrame, vertices: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Triangles with the positions of their corners: ax..az, bx.., cx.. One explode and one join, then regrouped."""
    carry = carry or ["px", "py", "pz"]
    slots = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("vid")) for i, c in enumerate("abc")])
    others = [c for c in triangles.columns if c != "tid"]
    each = triangles.select(*triangles.columns, F.explode(slots).alias("s")).select(*triangles.columns, "s.k", "s.vid")
    got = each.join(vertices.select("vid", *carry), "vid")
    wide = [F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{n}{c[1:] if c.startswith('p') else c}") for i, n in enumerate("abc") for c in carry]
    return got.groupBy("tid").agg(*[F.first(c).alias(c) for c in others], *wide)


def _abc() -> list[g.Vector]:
    return [g.vector(f"{n}x", f"{n}y", f"{n}z") for n in "abc"]


def face_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(tid, a, b, c, fx, fy, fz, area): unnormalised face normal and area."""
    n = g.triangle_normal(*_abc())
    full = corners_of(triangles, vertices).select("tid", "a", "b", "c", *[c.alias(k) for c, k in zip(n, ("fx", "fy", "fz"), strict=True)])
    return full.withColumn("area", 0.5 * g.length(g.vector("fx", "fy", "fz")))


def vertex_normals(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vertices`` with unit normals: the sum of the face normals around each, (0, 0, 1) where it vanishes.

    Sums are rounded to 1e-12, so that faces that cancel give zero in any order of addition.
    """
    faces = face_normals(triangles, vertices).select(F.explode(F.array("a", "b", "c")).alias("vid"), "fx", "fy", "fz")
    sums = faces.groupBy("vid").agg(*[F.round(F.sum(c), 12).alias(c) for c in ("fx", "fy", "fz")])
    f = g.vector("fx", "fy", "fz")
    unit, good = g.normalized(f), F.coalesce(g.length(f) > g.TINY, F.lit(False))
    return vertices.join(sums, "vid", "left").select("vid", "px", "py", "pz", *[F.when(good, c).otherwise(F.lit(d)).alias(n) for c, d, n in zip(unit, (0.0, 0.0, 1.0), ("nx", "ny", "nz"), strict=True)])


def edges(triangles: DataFrame) -> DataFrame:
    """(u, v, tid), u < v: the three sides of every triangle."""
    side = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    return triangles.select("tid", F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("e")).select("e.u", "e.v", "tid")


def edge_counts(triangles: DataFrame) -> DataFrame:
    """One row: edges, those of one triangle (boundary), of more than two (non-manifold)."""
    counted = edges(triangles).groupBy("u", "v").agg(F.least(F.count("*"), F.lit(255)).alias("n"))
    return counted.agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold"))


def adjacency(triangles: DataFrame) -> DataFrame:
    """(u, v): triangles that share an edge, each with the first of it; linear in the number of sides."""
    sides = cut(edges(triangles))
    first = sides.groupBy("u", "v").agg(F.min("tid").alias("first"))
    return sides.join(first, ["u", "v"]).where(F.col("tid") != F.col("first")).select(F.col("first").alias("u"), F.col("tid").alias("v"))


def components(triangles: DataFrame) -> DataFrame:
    """(tid, component): edge-connected groups, named by their smallest triangle."""
    found = connected_components(adjacency(triangles))
    return triangles.select("tid").join(found.withColumnRenamed("node", "tid"), "tid", "left").select("tid", F.coalesce("component", "tid").alias("component"))


def component_sizes(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(component, n, area, primary): the largest by triangles, then area, then name, is primary."""
    sizes = cut(components(triangles).join(face_normals(triangles, vertices).select("tid", "area"), "tid").groupBy("component").agg(F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area")))
    best = sizes.agg(F.max_by("component", F.struct("n", "area", -F.col("component"))).alias("best"))
    return sizes.join(F.broadcast(best), F.col("component") == F.col("best"), "left").select("component", "n", "area", F.col("best").isNotNull().alias("primary"))  # one row


def split(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """``triangles`` with ``primary``."""
    groups = components(triangles).join(component_sizes(triangles, vertices).select("component", "primary"), "component")
    return triangles.join(groups.select("tid", "primary"), "tid")


def compact(triangles: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only used vertices, renumbered from 0 by first use (triangle, corner); triangles follow."""
    slots = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("vid")) for i, c in enumerate("abc")])
    used = triangles.select("tid", F.explode(slots).alias("s")).groupBy("s.vid").agg(F.min(F.struct("tid", "s.k")).alias("first"))
    numbers = numbered(used, ["first"], "new").select("vid", "new")
    kept = vertices.join(numbers, "vid").select(F.col("new").alias("vid"), *[c for c in vertices.columns if c != "vid"])
    out = triangles
    for c in "abc":
        out = out.join(numbers.select(F.col("vid").alias(c), F.col("new").alias(f"new_{c}")), c)
    return kept, out.select("tid", *[F.col(f"new_{c}").alias(c) for c in "abc"])


def bounds(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[f(p).alias(f"{n}_{p}") for p in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max))])


def density_profile(grid: Grid, vertices: DataFrame, iso: float, marks: tuple[float, ...] = (64, 128, 192, 224)) -> DataFrame:
    """One row: smallest, largest and mean sampled value at the vertices, how many are below ``iso`` and the marks."""
    at = g.to_index(grid, F.col("px"), F.col("py"), F.col("pz"))
    points = vertices.select("vid", *[F.round(c, 9).alias(n) for c, n in zip(at, ("px", "py", "pz"), strict=True)])
    s = F.col("sampled")
    below = [F.count_if(s < m).alias(f"below_{int(m)}") for m in marks]
    return trilinear(grid, points).agg(F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.count_if(s < iso).alias("below_iso"), *below)


def winding_evidence(grid: Grid, triangles: DataFrame, vertices: DataFrame, sampled: int = 4096) -> DataFrame:
    """One row: triangles looked at and the sum of value differences across them; positive sums mean inward faces in fog.

    Every n-th triangle in order of id is looked at, half a voxel to either side of its middle.
    """
    total = triangles.count()
    stride = max(1, total // sampled)
    full = face_normals(triangles, vertices).where(F.pmod(F.xxhash64("tid"), F.lit(stride)) == 0)
    mids = corners_of(full.select("tid", "a", "b", "c"), vertices).select("tid", *[((F.col(f"a{k}") + F.col(f"b{k}") + F.col(f"c{k}")) / 3).alias(f"m{k}") for k in KEY])
    unit = g.normalized(g.vector("fx", "fy", "fz"))
    step = 0.5 * min(grid.spacing)
    both = full.join(mids, "tid").select("tid", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("side"), *[F.col(f"m{k}").alias(f"m{k}") for k in KEY], *[c.alias(f"u{k}") for c, k in zip(unit, KEY, strict=True)])
    at = g.to_index(grid, *[F.col(f"m{k}") + F.col("side") * step * F.col(f"u{k}") for k in KEY])
    points = both.select("tid", "side", *[c.alias(p) for c, p in zip(at, ("px", "py", "pz"), strict=True)])
    return trilinear(grid, points).agg((F.count("*") / 2).cast("long").alias("looked_at"), F.sum(F.col("side") * F.col("sampled")).alias("evidence"))


def ray_hit(triangles: DataFrame, vertices: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float]) -> DataFrame:
    """At most one row (tid, distance, u, v): the nearest triangle that a ray meets; boxes are tried first."""
    full = corners_of(triangles, vertices)
    low = tuple(F.least(*[F.col(f"{n}{k}") for n in "abc"]) for k in KEY)
    high = tuple(F.greatest(*[F.col(f"{n}{k}") for n in "abc"]) for k in KEY)
    near, far = g.ray_box(origin, direction, low, high)
    t, u, v = g.ray_triangle(origin, direction, *_abc())
    hits = full.where(near <= far).select("tid", t.alias("distance"), u.alias("u"), v.alias("v")).where("distance IS NOT NULL")
    best = hits.agg(F.min(F.struct("distance", "tid", "u", "v")).alias("h"))
    return best.where("h IS NOT NULL").select("h.tid", "h.distance", "h.u", "h.v")


def nearest_triangles(points: DataFrame, triangles: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """(pid, tid, d2): for each point (pid, wx, wy, wz) the nearest triangle within ``reach``.

    Triangles are binned by the cells of side ``reach`` that their boxes, widened by ``reach``, touch; a point looks
    into its own cell only. Points without a triangle so near give no row.
    """
    full = corners_of(triangles, vertices)
    size = float(reach)
    spans = [F.sequence(F.floor((F.least(*[F.col(f"{n}{k}") for n in "abc"]) - size) / size), F.floor((F.greatest(*[F.col(f"{n}{k}") for n in "abc"]) + size) / size)) for k in KEY]
    binned = full.select("*", F.explode(spans[0]).alias("qx")).select("*", F.explode(spans[1]).alias("qy")).select("*", F.explode(spans[2]).alias("qz"))
    looking = points.select("pid", "wx", "wy", "wz", *[F.floor(F.col(w) / size).alias(q) for w, q in zip(("wx", "wy", "wz"), ("qx", "qy", "qz"), strict=True)])
    d2 = g.point_triangle_d2(g.vector("wx", "wy", "wz"), *_abc())
    met = looking.join(binned, ["qx", "qy", "qz"]).select("pid", "tid", d2.alias("d2")).where(F.col("d2") <= size * size)
    return met.groupBy("pid").agg(F.min(F.struct("d2", "tid")).alias("m")).select("pid", "m.tid", "m.d2")


def near_vertices(samples: DataFrame, vertices: DataFrame, grid: Grid) -> DataFrame:
    """(vid, heat): the largest weight among samples (x, y, z, weight) in the 27 voxels around each vertex's voxel."""
    at = [g.nearest(c).alias(k) for c, k in zip(g.to_index(grid, F.col("px"), F.col("py"), F.col("pz")), KEY, strict=True)]
    from isovane.operators.stencil import box

    around = shifted(vertices.select("vid", *at), box(1, center=True))
    weights = samples.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), "weight")
    return around.join(weights, ["qx", "qy", "qz"]).groupBy("vid").agg(F.max("weight").alias("heat"))


def heatmap(samples: DataFrame, vertices: DataFrame, triangles: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(vertices with heat 0 to 1 and red, green, blue, alpha; triangles with any heat), by the largest weight of all."""
    heats = cut(near_vertices(samples, vertices, grid))
    top = heats.agg(F.max("heat")).first()[0] or 1.0
    share = F.col("heat") / F.lit(float(top))
    colors = heats.select("vid", share.alias("heat"), *[c.alias(n) for c, n in zip(g.heat_color(share), ("red", "green", "blue", "alpha"), strict=True)])
    hot = triangles.select("tid", "a", "b", "c", F.explode(F.array("a", "b", "c")).alias("vid")).join(heats.where("heat > 0").select("vid"), "vid", "left_semi").select("tid", "a", "b", "c").distinct()
    return colors, hot


def write_glb(out: BinaryIO, vertices: DataFrame, triangles: DataFrame, normals: bool = True) -> int:
    """A binary glTF file of compact tables (vids 0..n-1); returns its size.

    The numbers stream through the driver in order, a partition at a time; sizes and bounds come from aggregates.
    """
    n_v, n_t = vertices.count(), triangles.count()
    if not n_v or not n_t:
        raise ValueError("the mesh is empty")
    box = vertices.agg(*[f(F.col(p).cast("float")) for f in (F.min, F.max) for p in ("px", "py", "pz")], F.max("vid")).first()
    top = triangles.agg(F.max(F.greatest("a", "b", "c")), F.min(F.least("a", "b", "c"))).first()
    if box[6] != n_v - 1 or top[0] >= n_v or top[1] < 0:
        raise ValueError("vertex ids must be 0 to n - 1 and triangles must use them")
    views = [12 * n_v] + [12 * n_v] * normals + [12 * n_t]
    starts = [sum(views[:i]) for i in range(len(views))]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": n_v, "type": "VEC3", "min": list(box[:3]), "max": list(box[3:6])}]
    if normals:
        accessors.append({"bufferView": 1, "componentType": 5126, "count": n_v, "type": "VEC3"})
    accessors.append({"bufferView": len(views) - 1, "componentType": 5125, "count": 3 * n_t, "type": "SCALAR"})
    document = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0} | ({"NORMAL": 1} if normals else {}), "indices": len(accessors) - 1, "mode": 4}]}],
        "buffers": [{"byteLength": sum(views)}],
        "bufferViews": [{"buffer": 0, "byteOffset": s, "byteLength": n, "target": 34963 if i == len(views) - 1 else 34962} for i, (s, n) in enumerate(zip(starts, views, strict=True))],
        "accessors": accessors,
    }
    text = json.dumps(document, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    total = 12 + 8 + len(text) + 8 + sum(views)
    if total >= 1 << 32:
        raise ValueError("a GLB file holds less than 4 GiB")
    out.write(struct.pack("<4sIIII", b"glTF", 2, total, len(text), 0x4E4F534A) + text + struct.pack("<II", sum(views), 0x004E4942))
    for block in _packed(vertices.orderBy("vid").select("px", "py", "pz"), "<3f"):
        out.write(block)
    if normals:
        for block in _packed(vertices.orderBy("vid").select("nx", "ny", "nz"), "<3f"):
            out.write(block)
    for block in _packed(triangles.orderBy("tid").select("a", "b", "c"), "<3I"):
        out.write(block)
    return total


def _packed(rows: DataFrame, shape: str) -> Iterator[bytes]:
    pack = struct.Struct(shape).pack
    for row in rows.toLocalIterator():
        yield pack(*row)


def quantised_area(column: Column) -> Column:
    return F.round(column, 6) + F.lit(0.0)
