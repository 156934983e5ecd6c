"""Fitted, smoothed and oriented normals of surface samples, adjacency statistics, and local flips.

Samples have x, y, z, kind, wx, wy, wz and support. Neighbourhood fits run on tiles with a halo: each sample goes to
its own tile of ``TILE``^3 voxels and to those it is near, so a fit never looks beyond its task, and no task holds
more than (TILE + 2 * halo)^3 samples. Orientation and flips run on tiles too, many levels at a time (``waves.py``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.functions import geometry as g
from isovane.functions.linalg import canonical_sign
from isovane.operators import waves
from isovane.operators.stencil import KEY, box, half_box, neighbours
from isovane.operators.target import components, pack_key
from isovane.operators.tiles import tiled
from isovane.plans.lineage import cut

TILE = 16
#: Half extent and number of samples of the fitting neighbourhoods.
FIT = {"3x3": (1, 9), "5x5": (2, 25), "9x9": (4, 81)}
MIN_ALIGNMENT = 0.15
MAX_NORMAL_COMPONENT = 0.75


def box_neighbourhood(centers: DataFrame, core: DataFrame, half: int, most: int) -> DataFrame:
    """(x, y, z, n_.., hops, rank): the ``most`` nearest core samples in a box, by (hops, distance, sample order)."""
    near = neighbours(centers, core, box(half, center=True))
    hops = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    order = Window.partitionBy(*KEY).orderBy("hops", "d2", "qx", "qy", "qz")
    return near.withColumn("hops", hops).withColumn("d2", d2).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def connected_neighbourhood(core: DataFrame, half: int, most: int) -> DataFrame:
    """(x, y, z, qx, qy, qz, hops, d2, rank): as above, but reached through core samples inside the box.

    ``half`` rounds of a 26-neighbour join; each keeps the fewest hops of a pair.
    """
    keys = core.select(*KEY)
    links = cut(neighbours(keys, keys.withColumn("one", F.lit(1)), box(1)).select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.col("qx").alias("bx"), F.col("qy").alias("by"), F.col("qz").alias("bz")))
    reached = keys.select(*KEY, F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"), F.lit(0).alias("hops"))
    edge = reached
    for hop in range(1, half + 1):
        step = edge.join(links, (F.col("qx") == F.col("ax")) & (F.col("qy") == F.col("ay")) & (F.col("qz") == F.col("az")))
        within = (F.abs(F.col("bx") - F.col("x")) <= half) & (F.abs(F.col("by") - F.col("y")) <= half) & (F.abs(F.col("bz") - F.col("z")) <= half)
        more = step.where(within).select(*KEY, F.col("bx").alias("qx"), F.col("by").alias("qy"), F.col("bz").alias("qz")).distinct()
        edge = cut(more.join(reached, [*KEY, "qx", "qy", "qz"], "left_anti").withColumn("hops", F.lit(hop)))
        reached = reached.unionByName(edge)
    d = [F.col(q) - F.col(k) for q, k in zip(("qx", "qy", "qz"), KEY, strict=True)]
    order = Window.partitionBy(*KEY).orderBy("hops", "d2", "qx", "qy", "qz")
    return reached.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


class _Patches:
    """Core samples of a tile on a dense block, and the neighbourhoods of some centres as index tables."""

    def __init__(self, frame: pd.DataFrame, half: int):
        self.half, self.side = half, 2 * half + 1
        xyz = frame[KEY].to_numpy(np.int64)
        self.low = xyz.min(axis=0) - 2 * half
        shape = xyz.max(axis=0) + 2 * half - self.low + 1
        self.block = np.full(shape, -1, np.int64)
        order = np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0]))
        self.order = order
        core = order[(frame["kind"].to_numpy() == "core")[order]]
        at = xyz[core] - self.low
        self.block[at[:, 0], at[:, 1], at[:, 2]] = core
        self.xyz = xyz

    def around(self, centers: np.ndarray) -> np.ndarray:
        """(n, side, side, side): row numbers of the core samples around each centre, -1 for none."""
        at = self.xyz[centers] - self.low
        r = np.arange(-self.half, self.half + 1)
        return self.block[(at[:, 0, None] + r)[:, :, None, None], (at[:, 1, None] + r)[:, None, :, None], (at[:, 2, None] + r)[:, None, None, :]]

    def hops(self, patch: np.ndarray, connected: bool) -> np.ndarray:
        """Hops from the centre to each cell; -1 for cells not reached."""
        r = np.abs(np.arange(-self.half, self.half + 1))
        chebyshev = np.maximum(np.maximum(r[:, None, None], r[None, :, None]), r[None, None, :])
        if not connected:
            return np.where(patch >= 0, chebyshev, -1)
        out = np.full(patch.shape, -1)
        h = self.half
        reached = np.zeros(patch.shape, bool)
        reached[:, h, h, h] = patch[:, h, h, h] >= 0
        out[reached] = 0
        for hop in range(1, h + 1):
            grown = reached.copy()
            for axis in (1, 2, 3):
                a = np.moveaxis(grown, axis, 0)
                b = a.copy()
                b[1:] |= a[:-1]
                b[:-1] |= a[1:]
                grown = np.moveaxis(b, 0, axis)
            new = grown & (patch >= 0) & ~reached
            out[new] = hop
            reached |= new
        return out

    def nearest(self, centers: np.ndarray, most: int, connected: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, hops), both (n, most): neighbours by (hops, distance, order); rows are -1 beyond the last."""
        patch = self.around(centers)
        hops = self.hops(patch, connected).reshape(len(centers), -1)
        r = np.arange(-self.half, self.half + 1)
        d2 = (r[:, None, None] ** 2 + r[None, :, None] ** 2 + r[None, None, :] ** 2).ravel()
        key = np.where(hops >= 0, (hops * 4096 + d2) * 4096 + np.arange(len(d2)), np.iinfo(np.int64).max)
        pick = np.argsort(key, axis=1, kind="stable")[:, :most]
        rows, found = np.take_along_axis(patch.reshape(len(centers), -1), pick, 1), np.take_along_axis(hops, pick, 1)
        return np.where(found >= 0, rows, -1), found


def _plane_axes(points: np.ndarray, rows: np.ndarray, hops: np.ndarray, rounds: int) -> np.ndarray:
    """Normals (n, 3) of robust plane fits through weighted points; zero for fewer than three."""
    there = rows >= 0
    p = points[np.maximum(rows, 0)]
    base = np.where(there, 1.0 / (1.0 + 0.5 * hops), 0.0)
    weight, axis = base.copy(), np.zeros((len(rows), 3))
    count = there.sum(axis=1)
    good = count >= 3
    for n in range(max(1, rounds)):
        total = weight.sum(axis=1)
        mean = (p * weight[:, :, None]).sum(axis=1) / np.maximum(total, 1e-20)[:, None]
        delta = p - mean[:, None, :]
        axis = np.linalg.eigh(np.einsum("nk,nki,nkj->nij", weight, delta, delta))[1][:, :, 0]
        if n + 1 >= max(1, rounds):
            break
        residual = np.abs(np.einsum("nki,ni->nk", delta, axis))
        ordered = np.sort(np.where(there, residual, np.inf), axis=1)
        middle = ordered[np.arange(len(rows)), np.minimum(count // 2, rows.shape[1] - 1)]
        scale = np.maximum(1e-6, 1.4826 * np.where(np.isfinite(middle), middle, 0.0))
        weight = base / np.maximum(residual / (2.5 * scale[:, None]), 1.0)
    return np.where(good[:, None], canonical_sign(axis), 0.0)


def _mean_axes(axes: np.ndarray, rows: np.ndarray, weight: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Sign-free mean directions: the strongest axis of summed n n'; zero where nothing is summed."""
    n = axes[np.maximum(rows, 0)]
    w = np.where((rows >= 0) & ((n**2).sum(axis=2) > g.TINY), weight, 0.0)
    tensor = np.einsum("nk,nki,nkj->nij", w, n, n)
    if start is not None:
        tensor = tensor + start
    some = np.abs(tensor).max(axis=(1, 2)) > g.TINY
    return np.where(some[:, None], canonical_sign(np.linalg.eigh(tensor)[1][:, :, 2]), 0.0)


_FIELD = "x int, y int, z int, kind string, wx double, wy double, wz double, support double, nx double, ny double, nz double"


def _by_tile(samples: DataFrame, halo: int, run) -> DataFrame:
    """Apply ``run`` (tile's rows, halo included -> normals of all rows) and keep what belongs to the tile."""

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        own = np.ones(len(frame), bool)
        for k, t in zip(KEY, key, strict=True):
            own &= frame[k].to_numpy() // TILE == t
        rows = np.flatnonzero(own)
        n = run(frame, rows) if len(rows) else np.zeros((0, 3))
        return frame.loc[rows, [*KEY, "kind", "wx", "wy", "wz", "support"]].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])

    return tiled(samples, halo, TILE).groupBy("tx", "ty", "tz").applyInPandas(each, _FIELD)


def fit(samples: DataFrame, neighbourhood: str = "9x9", rounds: int = 2) -> DataFrame:
    """``samples`` (x, y, z, kind, wx, wy, wz, support) with unsigned axes nx, ny, nz from positions alone.

    Core: robust plane fits to connected neighbourhoods. Transition: the mean of the core axes in the box, weighted by
    hops and support. Axes have no sign; the largest component is made positive.
    """
    if rounds < 1:
        raise ValueError("at least one round")
    half, most = FIT[neighbourhood]

    def run(frame: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        patches = _Patches(frame, half)
        core = np.flatnonzero(frame["kind"].to_numpy() == "core")
        axes = np.zeros((len(frame), 3))
        points = frame[["wx", "wy", "wz"]].to_numpy(float)
        outer = own[frame["kind"].to_numpy()[own] != "core"]
        wanted = core if len(outer) else own  # transitions also look at the axes of their neighbours
        for lo in range(0, len(wanted), 512):
            block = wanted[lo : lo + 512]
            if len(block):
                axes[block] = _plane_axes(points, *patches.nearest(block, most, True), rounds)
        for lo in range(0, len(outer), 512):
            block = outer[lo : lo + 512]
            rows, hops = patches.nearest(block, most, False)
            support = np.clip(frame["support"].to_numpy(float), 0, 1)[np.maximum(rows, 0)]
            axes[block] = _mean_axes(axes, rows, support / (1.0 + np.maximum(hops, 0)))
        return axes[own]

    return _by_tile(samples.select(*KEY, "kind", "wx", "wy", "wz", "support"), 2 * half, run)


def smooth(field: DataFrame, neighbourhood: str | None = "3x3", strength: float = 1.0) -> DataFrame:
    """Axes averaged with those of the core samples around, by 1 / (1 + hops); ``None`` gives the field unchanged."""
    if not 0 <= strength <= 1:
        raise ValueError("the strength is 0 to 1")
    if neighbourhood is None:
        return field
    half, most = FIT[neighbourhood]

    def run(frame: pd.DataFrame, own: np.ndarray) -> np.ndarray:
        patches = _Patches(frame, half)
        axes = frame[["nx", "ny", "nz"]].to_numpy(float)
        out = axes[own].copy()
        core = frame["kind"].to_numpy()[own] == "core"
        for connected in (True, False):
            mine = np.flatnonzero(core == connected)
            for lo in range(0, len(mine), 512):
                block = mine[lo : lo + 512]
                rows, hops = patches.nearest(own[block], most, connected)
                weight = strength / (1.0 + np.maximum(hops, 0))
                if not connected:
                    weight = weight * np.clip(frame["support"].to_numpy(float), 0, 1)[np.maximum(rows, 0)]
                center = axes[own[block]]
                start = (1.0 - strength) * np.einsum("ni,nj->nij", center, center)
                mean = _mean_axes(axes, rows, weight, start)
                out[block] = np.where((mean**2).sum(axis=1, keepdims=True) > g.TINY, mean, center)
        return out

    return _by_tile(field.select(*KEY, "kind", "wx", "wy", "wz", "support", "nx", "ny", "nz"), half, run)


def _pairs(field: DataFrame, other: DataFrame, offsets: list, grid_spacing: tuple[float, float, float]) -> DataFrame:
    """Neighbour pairs with ids u, v, both axes, the world step and its squared index length."""
    columns = [*KEY, "kind", "nx", "ny", "nz"]
    met = neighbours(field.select(*columns), other.select(*columns), offsets)
    ids = [pack_key(*map(F.col, KEY)).alias("u"), pack_key(F.col("qx"), F.col("qy"), F.col("qz")).alias("v")]
    step = [(F.col(d) * F.lit(float(s))).alias(f"s{d[1]}") for d, s in zip(("dx", "dy", "dz"), grid_spacing, strict=True)]
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    return met.select(*ids, *KEY, "kind", "n_kind", "dx", "dy", "dz", d2.alias("d2"), "nx", "ny", "nz", "n_nx", "n_ny", "n_nz", *step)


def adjacency(field: DataFrame) -> DataFrame:
    """(x, y, z, qx, qy, qz, kind, n_kind, aligned): each undirected pair of neighbours with valid normals once."""
    unit = g.normalized(g.vector("nx", "ny", "nz"))
    valid = cut(field.select(*KEY, "kind", *[c.alias(n) for c, n in zip(unit, ("nx", "ny", "nz"), strict=True)])).where("nx <> 0 OR ny <> 0 OR nz <> 0")
    met = neighbours(valid, valid, half_box())
    aligned = g.clamp(g.dot(g.vector("nx", "ny", "nz"), g.vector("n_nx", "n_ny", "n_nz")), -1, 1)
    return met.select(*KEY, "qx", "qy", "qz", "kind", "n_kind", aligned.alias("aligned"))


def valid_components(field: DataFrame) -> DataFrame:
    """(x, y, z, component): 26-connected groups of the core samples of ``field`` that have a normal."""
    squared = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")
    return components(field.where((F.col("kind") == "core") & (squared > 1e-20)))


def adjacency_statistics(field: DataFrame, weak: float = 0.15) -> DataFrame:
    """One row: numbers of core and transition edges, opposing and weak ones, least and mean alignments of core edges."""
    pairs = adjacency(field)
    core = (F.col("kind") == "core") & (F.col("n_kind") == "core")
    a = F.when(core, F.col("aligned"))
    return pairs.agg(
        F.count_if(core).alias("core_edges"), F.count_if(core & (F.col("aligned") < 0)).alias("core_opposing"), F.count_if(core & (F.abs("aligned") < weak)).alias("core_weak"),
        F.min(a).alias("least_signed"), F.min(F.abs(a)).alias("least_absolute"), F.avg(a).alias("mean_signed"), F.avg(F.abs(a)).alias("mean_absolute"),
        F.count_if(~core).alias("transition_edges"), F.count_if(~core & (F.col("aligned") < 0)).alias("transition_opposing"),
    )


def worst_edges(field: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` opposing edges of each class (core, transition) by alignment to nine places, then place: a report."""
    pairs = adjacency(field).where("aligned < 0").withColumn("class", F.when((F.col("kind") == "core") & (F.col("n_kind") == "core"), "core").otherwise("transition"))
    keys = [F.round("aligned", 9), *KEY, "qx", "qy", "qz"]
    parts = [pairs.where(F.col("class") == c).orderBy(*keys).limit(most) for c in ("core", "transition")]
    return parts[0].unionByName(parts[1]).select("class", *KEY, "qx", "qy", "qz", "aligned")


def supported_transitions(field: DataFrame) -> DataFrame:
    """(x, y, z, supported): transitions with and without a valid core neighbour."""
    valid = field.where("nx <> 0 OR ny <> 0 OR nz <> 0")
    outer, core = valid.where("kind = 'transition'").select(*KEY), valid.where("kind = 'core'").select(*KEY, F.lit(True).alias("core"))
    met = neighbours(outer, core, box(1)).select(*KEY).distinct().withColumn("supported", F.lit(True))
    return outer.join(met, KEY, "left").select(*KEY, F.coalesce("supported", F.lit(False)).alias("supported"))


def nearest_core(samples: DataFrame, at: tuple[float, float, float]) -> DataFrame:
    """The core sample nearest to a world position (one row), equal ones in (x, y, z) order."""
    d2 = sum((F.col(w) - F.lit(float(p))) * (F.col(w) - F.lit(float(p))) for w, p in zip(("wx", "wy", "wz"), at, strict=True))
    return samples.where("kind = 'core'").withColumn("d2", d2).orderBy("d2", *KEY).limit(1)


def _at(rows: DataFrame, place: tuple[int, int, int] | None) -> DataFrame:
    """The rows at ``place``; none where there is no place."""
    return rows.where(F.lit(False) if place is None else F.expr(" AND ".join(f"{k} = {int(c)}" for k, c in zip(KEY, place, strict=True))))


def orient(field: DataFrame, seed: tuple[int, int, int] | None, direction: tuple[float, float, float], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), min_alignment: float = MIN_ALIGNMENT, max_component: float = MAX_NORMAL_COMPONENT) -> DataFrame:
    """``field`` with consistent signs spread from ``seed``, ``oriented``, ``depth`` and ``parent`` (packed key).

    A wavefront over core samples, level by level: a sample gets its sign when two oriented neighbours (one next to the
    seed) vote for it clearly; then two passes in which all vote again with the seed fixed; then transitions, from core
    neighbours first and from each other after. Levels run in batches on tiles with a deep halo, see waves.spread().
    Rows of one kind that share a place take part once. Without a seed, or a valid core sample there, nothing is oriented.
    """
    valid = cut(field.where("nx <> 0 OR ny <> 0 OR nz <> 0").select(*KEY, "kind", "nx", "ny", "nz").dropDuplicates([*KEY, "kind"]))
    core = valid.where("kind = 'core'").drop("kind")
    mine = g.vector("nx", "ny", "nz")
    positive = g.dot(mine, tuple(F.lit(float(d)) for d in direction)) >= 0
    first = _at(core, seed).select(*KEY, F.when(positive, 1).otherwise(-1).alias("sign"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), *[F.lit(0).alias(p) for p in ("ex", "ey", "ez")])
    found = waves.spread(core, first, waves.signs(spacing, min_alignment, max_component))
    signed = core.join(found.select(*KEY, "sign", "depth", "parent"), KEY)
    signs = waves.revoted(signed, spacing, min_alignment, max_component)
    flip = lambda c: F.col(c) * F.col("sign")
    core_out = core.join(signs, KEY, "left").select(*KEY, F.lit("core").alias("kind"), *[F.coalesce(flip(c), F.lit(0.0)).alias(c) for c in ("nx", "ny", "nz")], F.col("sign").isNotNull().alias("oriented"), "depth", "parent")
    core_out = cut(core_out)
    outer_out = _orient_transitions(valid.where("kind = 'transition'"), core_out.where("oriented"), spacing, max_component)
    return core_out.unionByName(outer_out)


def _orient_transitions(outer: DataFrame, core: DataFrame, spacing, max_component: float) -> DataFrame:
    """Transitions: the weighted mean of oriented core normals beside them, else the sign of an oriented neighbour."""
    mine, theirs, step = g.vector("nx", "ny", "nz"), g.vector("n_nx", "n_ny", "n_nz"), g.vector("sx", "sy", "sz")
    met = _pairs(outer, core, box(1, center=True), spacing).where(g.continues(step, mine, theirs, max_component))
    direct = met.groupBy(*KEY).agg(*[F.sum(c * 0.5).alias(n) for c, n in zip(theirs, ("tx", "ty", "tz"), strict=True)])
    unit = g.normalized(g.vector("tx", "ty", "tz"))
    first = direct.select(*KEY, *[c.alias(n) for c, n in zip(unit, ("ox", "oy", "oz"), strict=True)], F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).where("ox <> 0 OR oy <> 0 OR oz <> 0")
    done = waves.spread(outer.drop("kind"), first, waves.carried(spacing, max_component))
    keyed = outer.join(done, KEY, "left")
    return keyed.select(*KEY, "kind", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(("ox", "oy", "oz"), ("nx", "ny", "nz"), strict=True)], F.col("ox").isNotNull().alias("oriented"), "depth", "parent")


def expansion(oriented: DataFrame, at: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, role): what the wavefront did around a sample: its children, and siblings under its parent."""
    key = pack_key(*[F.lit(c) for c in at])
    rows = oriented.where("kind = 'core'").withColumn("node", pack_key(*map(F.col, KEY)))
    own = rows.where(F.col("node") == key).select(F.col("parent").alias("p")).limit(1)
    children = rows.where(F.col("parent") == key).select(*KEY, F.lit("child").alias("role"))
    siblings = rows.join(F.broadcast(own), F.col("parent") == F.col("p")).where(F.col("node") != key).select(*KEY, F.lit("sibling").alias("role"))  # one row
    return children.unionByName(siblings)


def flip_preview(field: DataFrame, start: tuple[int, int, int] | None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), cap: int = 250_000, most_mm: float = 0.0, min_alignment: float = MIN_ALIGNMENT, max_component: float = MAX_NORMAL_COMPONENT, trace: DataFrame | None = None) -> DataFrame:
    """(node, role, reason, parent, depth): core samples that a flip at ``start`` would turn, and where the chain stops.

    The chain goes on to neighbours (to children only, with a ``trace`` of node, parent) that now agree with the turned
    sample's old normal. It stops, in this order, at invalid normals, where the surface doesn't continue, at weak
    alignment, beyond ``most_mm`` (0: no limit), and at normals that are right after the flip. All of these depend on
    the pair alone. With ``cap`` or more affected samples, those up to the level that reaches it get the role ``capped``, and
    applying does nothing. Equal depths: the smallest parent; several reasons at a boundary sample: the first. Without a
    start, or a valid core sample there, there are no rows. Levels run in batches on tiles, see waves.spread(); counts by level keep the cap exact.
    """
    core = field.where("kind = 'core'").select(*KEY, "nx", "ny", "nz").dropDuplicates(KEY)
    node, mine = pack_key(*map(F.col, KEY)), g.vector("nx", "ny", "nz")
    if trace is not None:
        leaders = trace.select(F.col("node").alias("_node"), F.col("parent").alias("leader"))
        core = core.withColumn("_node", node).join(leaders, "_node", "left").drop("_node").withColumn("leader", F.coalesce("leader", F.lit(waves.NEVER)).cast("long"))
    none, number = F.lit(None).cast("long"), F.lit(None).cast("int")
    begin = _at(core.where(g.dot(mine, mine) > g.TINY), start)
    first = begin.select(*KEY, F.lit(0).alias("depth"), none.alias("parent"), number.alias("stop"))
    step = waves.chain(start, spacing, most_mm, min_alignment, max_component, trace is not None)
    found = cut(waves.spread(core, first, step, lambda rows: rows.where("depth IS NOT NULL").count() >= cap))
    affected = found.where("depth IS NOT NULL").select(node.alias("node"), "parent", "depth")
    levels = affected.groupBy("depth").agg(F.count("*").alias("n"))  # a row for each level
    running = levels.select("depth", F.sum("n").over(Window.orderBy("depth")).alias("n"))
    full = running.where(F.col("n") >= cap).agg(F.min("depth")).first()[0]
    if full is not None:
        return affected.where(F.col("depth") <= full).select("node", F.lit("capped").alias("role"), F.lit("sample cap").alias("reason"), "parent", "depth")
    reason = F.get(F.array(*[F.lit(r) for r in waves.REASONS]), F.min("stop") - 1)
    edge = found.where("stop IS NOT NULL").groupBy(node.alias("node")).agg(reason.alias("reason")).select("node", F.lit("boundary").alias("role"), "reason", none.alias("parent"), number.alias("depth"))
    return affected.select("node", F.lit("affected").alias("role"), F.lit(None).cast("string").alias("reason"), "parent", "depth").unionByName(edge)


def apply_flip(field: DataFrame, preview: DataFrame) -> DataFrame:
    """``field`` with affected core normals turned; a transition turns when half or more of its core neighbours did."""
    if not preview.where("role = 'capped'").isEmpty():
        return field
    turned = preview.where("role = 'affected'").select("node", F.lit(True).alias("turn"))
    keyed = field.withColumn("node", pack_key(*map(F.col, KEY))).join(turned, "node", "left")
    core = keyed.where("kind = 'core'").select(*KEY, F.coalesce("turn", F.lit(False)).alias("turn"))
    votes = neighbours(keyed.where("kind <> 'core'").select(*KEY), core, box(1)).groupBy(*KEY).agg((2 * F.count_if("n_turn") >= F.count("*")).alias("major"), F.count_if("n_turn").alias("some"))
    both = keyed.join(votes, KEY, "left")
    flips = F.coalesce("turn", F.lit(False)) | F.coalesce(F.col("major") & (F.col("some") > 0), F.lit(False))
    names = ("nx", "ny", "nz")
    return both.select(*[F.when(flips, -F.col(c)).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in field.columns])


def replay(field: DataFrame, starts: list[tuple[int, int, int]], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Accepted flips in list order, from an unchanged baseline."""
    out = field
    for start in starts:
        out = cut(apply_flip(out, flip_preview(out, start, spacing)))
    return out


def boundary_reasons(preview: DataFrame) -> DataFrame:
    """(reason, n) of the boundary samples."""
    return preview.where("role = 'boundary'").groupBy("reason").agg(F.count("*").alias("n"))


def angle_between(a: g.Vector, b: g.Vector) -> Column:
    return F.acos(g.clamp(F.abs(g.dot(a, b)), 0, 1))
