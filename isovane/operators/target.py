"""Surface samples of a grid: core voxels, transition layers, normals, planarity, and the largest component."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import tiles
from isovane.operators.stencil import KEY, SIX, count_neighbours, diamond, gather, half_box, neighbours, shifted
from isovane.operators.tiles import CORNERS
from isovane.plans.fixpoint import connected_components
from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered
from isovane.sources.voxels import FOG, Grid


@dataclass(frozen=True)
class TargetSettings:
    iso: float = 255.0
    layers: int = 2
    planarity_radius: float = 0.002
    angular_scale: float = math.radians(15)

    def __post_init__(self):
        numbers = (self.iso, self.planarity_radius, self.angular_scale)
        if not all(map(math.isfinite, numbers)) or not 1 <= self.layers <= 255 or min(numbers[1:]) <= 0:
            raise ValueError("settings must be finite, with 1 to 255 layers and a positive radius and scale")


def core_voxels(grid: Grid, iso: float) -> DataFrame:
    """(x, y, z, value, crossings): active inside voxels with an outside axis neighbour.

    Neighbours count whether active or not. Only the side that the background isn't on is counted, by partial sums on
    shifted keys, so there is no lookup of absent places.
    """
    inside = grid.inside(F.col("value"), iso)
    known = grid.background_inside(iso)
    others = count_neighbours(grid.voxels.where(~inside if known else inside), SIX)
    held = grid.voxels.where(inside & F.col("active")).select(*KEY, "value").join(others, KEY, "left")
    n = F.coalesce("n", F.lit(0))
    return held.withColumn("crossings", (n if known else 6 - n).cast("int")).where("crossings > 0").select(*KEY, "value", "crossings")


def transition_layers(grid: Grid, core: DataFrame, iso: float, layers: int) -> DataFrame:
    """(x, y, z, value, layer): outside voxels, not background, within ``layers`` steps of a core voxel; the fewest steps."""
    steps = F.abs("dx") + F.abs("dy") + F.abs("dz")
    reach = shifted(core.select(*KEY), diamond(layers)).groupBy(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")).agg(F.min(steps).cast("short").alias("layer"))
    near = grid.voxels.where(~grid.inside(F.col("value"), iso) & (F.col("value") != F.lit(grid.background)))
    return near.select(*KEY, "value").join(reach, KEY)


def classified(grid: Grid, settings: TargetSettings) -> DataFrame:
    """(x, y, z, value, kind, layer, support): core and transition samples in one table."""
    core = cut(core_voxels(grid, settings.iso))
    outer = transition_layers(grid, core, settings.iso, settings.layers)
    support = g.transition_support(F.col("value"), F.col("layer"), settings.iso, settings.layers, grid.grid_class == FOG)
    return core.select(*KEY, "value", F.lit("core").alias("kind"), F.lit(0).cast("short").alias("layer"), F.lit(1.0).alias("support")).unionByName(
        outer.select(*KEY, "value", F.lit("transition").alias("kind"), "layer", support.alias("support"))
    )


def crossings(grid: Grid, core: DataFrame, iso: float) -> DataFrame:
    """(x, y, z, slot, t): for each core voxel the axis directions in which the surface is crossed, and where."""
    looked = shifted(core.select(*KEY, "value"), SIX)
    there = grid.voxels.select(*[F.col(k).alias(q) for k, q in zip(KEY, ("qx", "qy", "qz"), strict=True)], F.col("value").alias("other"))
    joined = looked.join(there, ["qx", "qy", "qz"], "left").withColumn("other", F.coalesce("other", F.lit(grid.background)))
    crossed = joined.where(~grid.inside(F.col("other"), iso))
    return crossed.select(*KEY, "slot", "dx", "dy", "dz", g.crossing(F.col("value"), F.col("other"), iso).alias("t"))


def extract(grid: Grid, settings: TargetSettings) -> DataFrame:
    """All samples of the surface: position, normal, density, planarity, deviation, support, layer and kind. One shuffle."""
    world = g.to_world(grid, F.col("x"), F.col("y"), F.col("z"))
    full = tiles.surface(grid, settings)
    return full.select(
        *KEY, *[w.cast("float").alias(n) for w, n in zip(world, ("wx", "wy", "wz"), strict=True)], *[F.col(n).cast("float").alias(n) for n in ("nx", "ny", "nz")],
        F.col("value").cast("float").alias("density"), F.col("planarity").cast("float").alias("planarity"), F.col("deviation").cast("float").alias("deviation"),
        F.col("support").cast("float").alias("support"), "layer", "kind",
    )


def with_ids(samples: DataFrame) -> DataFrame:
    """``samples`` with ``sample_id``, their place in (x, y, z) order, from 0."""
    return numbered(samples, KEY, "sample_id")


def core_at(places: DataFrame, core: DataFrame) -> DataFrame:
    """``places`` (x, y, z and others) at which a core sample is, with its columns; others give no row."""
    return places.join(core, KEY)


def zipped(samples: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both with the same place, side by side. Raises unless the two match one to one."""
    both = cut(samples.join(other, KEY))
    counts = samples.count(), other.count(), both.count(), both.select(*KEY).distinct().count()
    if len(set(counts)) > 1:
        raise ValueError(f"samples and values don't match: {counts[0]}, {counts[1]} rows, {counts[2]} pairs")
    return both


def pack_key(x: Column, y: Column, z: Column) -> Column:
    """Coordinates (within 2^20 of 0) as one long that sorts like (x, y, z)."""
    shift = lambda c: c.cast("long") + F.lit(1 << 20)
    return F.shiftleft(shift(x), 42) + F.shiftleft(shift(y), 21) + shift(z)


def unpack_key(key: Column) -> g.Vector:
    part = lambda n: (F.shiftright(key, n).bitwiseAND(F.lit((1 << 21) - 1)) - F.lit(1 << 20)).cast("int")
    return part(42), part(21), part(0)


def components(core: DataFrame) -> DataFrame:
    """(x, y, z, component): 26-connected groups, named by the packed key of their first voxel."""
    keyed = core.select(*KEY).distinct()
    edges = neighbours(keyed, keyed.withColumn("one", F.lit(1)), half_box()).select(pack_key(F.col("x"), F.col("y"), F.col("z")).alias("u"), pack_key(F.col("qx"), F.col("qy"), F.col("qz")).alias("v"))
    found = connected_components(edges)
    named = keyed.withColumn("node", pack_key(F.col("x"), F.col("y"), F.col("z"))).join(found, "node", "left")
    return named.select(*KEY, F.coalesce("component", "node").alias("component"))


def largest(groups: DataFrame) -> DataFrame:
    """(component, n) of the largest component; equal ones: the one with the first voxel."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by(F.struct("component", "n"), F.struct("n", -F.col("component"))).alias("top")).where("top IS NOT NULL").select("top.component", "top.n")


def split_primary(samples: DataFrame) -> DataFrame:
    """``samples`` with ``primary``: core of the largest component, and transitions within their own layer of it.

    Without any core sample all are primary.
    """
    core = samples.where("kind = 'core'")
    groups = cut(components(core))
    best = largest(groups)
    main = cut(groups.join(F.broadcast(best.select("component")), "component", "left_semi").select(*KEY))  # one row
    if main.isEmpty():
        return samples.withColumn("primary", F.lit(True))
    layers = samples.agg(F.max("layer")).first()[0] or 1
    outer = samples.where("kind <> 'core'")
    steps = F.abs("dx") + F.abs("dy") + F.abs("dz")
    reach = shifted(outer.select(*KEY, "layer"), diamond(max(1, layers), center=True)).where(steps <= F.greatest(F.col("layer"), F.lit(1)))
    beside = reach.join(main.select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")), ["qx", "qy", "qz"], "left_semi").select(*KEY)
    chosen = main.unionByName(beside).distinct().withColumn("primary", F.lit(True))
    return samples.join(chosen, KEY, "left").withColumn("primary", F.coalesce("primary", F.lit(False)))


def central_gradient(grid: Grid, samples: DataFrame) -> DataFrame:
    """``samples`` with the world gradient gx, gy, gz by central differences, pointing outward."""
    wide = gather(samples, grid.voxels, SIX, grid.background)
    parts = [(F.col(f"v{2 * a}") - F.col(f"v{2 * a + 1}")) * F.lit(0.5 * grid.outward() / s) for a, s in enumerate(grid.spacing)]
    return wide.select(*samples.columns, *[p.alias(n) for p, n in zip(parts, ("gx", "gy", "gz"), strict=True)])


def trilinear(grid: Grid, points: DataFrame) -> DataFrame:
    """``points`` (index positions px, py, pz) with the trilinear ``sampled`` value and world gradient tx, ty, tz.

    A point is at its cell's base (floor) and fractions; the cell's eight corners are looked up, background if absent.
    """
    base = points.select("*", *[F.floor(p).cast("int").alias(k) for p, k in zip(("px", "py", "pz"), KEY, strict=True)])
    corners = gather(base.select(*KEY).distinct(), grid.voxels, CORNERS, grid.background)
    wide = base.join(corners, KEY)
    f = [F.col(p) - F.col(k) for p, k in zip(("px", "py", "pz"), KEY, strict=True)]

    def mix(derive: int | None) -> Column:
        total = None
        for i, corner in enumerate(CORNERS):
            term = F.col(f"v{i}")
            for a, bit in enumerate(corner):
                if a == derive:
                    term = term if bit else -term
                else:
                    term = term * (f[a] if bit else 1.0 - f[a])
            total = term if total is None else total + term
        return total

    gradient = [mix(a) * F.lit(grid.outward() / s) for a, s in enumerate(grid.spacing)]
    return wide.select(*points.columns, mix(None).alias("sampled"), *[c.alias(n) for c, n in zip(gradient, ("tx", "ty", "tz"), strict=True)])
