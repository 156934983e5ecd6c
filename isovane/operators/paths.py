"""Shortest paths over sample graphs by rounds of tiles: bounded sweeps from many sources, routes, and brush strokes."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.functions import geometry as g
from isovane.operators import tiles
from isovane.operators.stencil import KEY, box, neighbours
from isovane.operators.target import pack_key, unpack_key
from isovane.plans.lineage import cut
from isovane.sources.voxels import Grid


@dataclass(frozen=True)
class BrushSettings:
    """A brush and how it spreads, in world units. Radius and search of 0 follow the voxel size."""

    core: float
    width: float
    strength: float = 1.0
    iso: float = 255.0
    planarity_radius: float = 0.0
    angular_scale: float = math.radians(15)
    plane_penalty: float = 16.0
    normal_penalty: float = 0.5
    normal_scale: float = math.radians(20)
    search: float = 0.0

    def __post_init__(self):
        numbers = (self.core, self.width, self.strength, self.iso, self.planarity_radius, self.angular_scale, self.plane_penalty, self.normal_penalty, self.normal_scale, self.search)
        if not all(map(math.isfinite, numbers)) or min(numbers[:3] + numbers[4:]) < 0 or self.core + self.width <= 0 or min(self.angular_scale, self.normal_scale) <= 0:
            raise ValueError("a brush needs finite settings, none negative, a positive size and positive scales")


def cost_graph(samples: DataFrame, spacing: tuple[float, float, float], plane_penalty: float = 16.0, normal_penalty: float = 0.5, scale: float = math.radians(20)) -> DataFrame:
    """(u, v, cost) in both directions between 26-neighbours of samples (x, y, z, nx, ny, nz, planarity)."""
    met = neighbours(samples.select(*KEY, "nx", "ny", "nz", "planarity"), samples.select(*KEY, "nx", "ny", "nz", "planarity"), box(1))
    delta = tuple(F.col(d) * F.lit(float(s)) for d, s in zip(("dx", "dy", "dz"), spacing, strict=True))
    cost = g.edge_cost(delta, g.vector("nx", "ny", "nz"), g.vector("n_nx", "n_ny", "n_nz"), F.col("planarity"), F.col("n_planarity"), plane_penalty, normal_penalty, scale)
    return met.select(pack_key(*map(F.col, KEY)).alias("u"), pack_key(F.col("qx"), F.col("qy"), F.col("qz")).alias("v"), cost.alias("cost")).where(F.col("cost") < float("inf"))


def _settle(state: pd.DataFrame, edges: pd.DataFrame, limit: float) -> list[tuple]:
    """(node, dist, parent) that get better when the ``fresh`` nodes spread over the edges of one tile; sources have parent -1."""
    order = np.argsort(edges["u"].to_numpy(), kind="stable")
    u, v, cost = (edges[c].to_numpy()[order] for c in ("u", "v", "cost"))
    at = dict(zip(*(x.tolist() for x in np.unique(u, return_index=True)), strict=True))
    ends = dict(zip(at, [*list(at.values())[1:], len(u)], strict=True))
    v, cost = v.tolist(), cost.tolist()
    known = {n: (d, p) for n, d, p in zip(state["node"].tolist(), state["dist"].tolist(), state["parent"].tolist(), strict=True)}
    better = {}
    queue = [(known[n][0], n) for n in state["node"][state["fresh"]].tolist()]
    heapq.heapify(queue)
    while queue:
        d, n = heapq.heappop(queue)
        if d > known[n][0] or n not in at:
            continue
        for i in range(at[n], ends[n]):
            there, far = v[i], d + cost[i]
            old, parent = known.get(there, (math.inf, -1))
            if far < old and far < limit:
                known[there] = better[there] = (far, n)
                heapq.heappush(queue, (far, there))
            elif far == old and cost[i] > 0 and n < parent:
                known[there] = better[there] = (far, n)
    return [(n, *o) for n, o in better.items()]


def relax(sources: DataFrame, links: DataFrame, limit: float = float("inf"), ends: DataFrame | None = None) -> DataFrame:
    """(pair, node, dist, parent): least cost from the sources (pair, node) of each pair to each node, below ``limit``.

    Nodes are packed places. In each round the tiles with changed nodes settle all they can on their own edges and offer
    the rest to the tiles around, so rounds are as many as the tiles that a path crosses, and a task holds one tile of
    one pair. Equal costs go to the smaller parent. With ``ends`` (pair, node) costs from that of a pair's end on don't count.
    """
    tile = [F.floor(c / tiles.SIDE).alias(t) for c, t in zip(unpack_key(F.col("node")), tiles.TILE, strict=True)]
    key = ["pair", *tiles.TILE]
    edges = cut(links.select("u", "v", "cost", *[F.floor(c / tiles.SIDE).alias(t) for c, t in zip(unpack_key(F.col("u")), tiles.TILE, strict=True)]))
    best, n = cut(sources.select("pair", "node").distinct().select("pair", "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("round"))), 0
    while not best.where(F.col("round") == n).isEmpty():
        placed = best.select("*", *tile)
        active = placed.where(F.col("round") == n).select(*key).distinct()
        # Whole numbers without nulls: pandas would turn packed places into floats.
        state = placed.join(active, key, "left_semi").withColumn("fresh", F.col("round") == n).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))
        if ends is None:
            state = state.withColumn("bound", F.lit(limit))
        else:
            bound = best.join(ends, ["pair", "node"]).select("pair", "dist").toDF("pair", "bound")
            state = state.join(bound, "pair", "left").withColumn("bound", F.least(F.coalesce("bound", F.lit(limit)), F.lit(limit)))

        def spread(group: tuple, known: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            found = _settle(known, near, float(known["bound"].iloc[0])) if len(known) and len(near) else []
            return pd.DataFrame([(group[0], *f) for f in found], columns=["pair", "node", "dist", "parent"])

        offers = state.groupBy(*key).cogroup(edges.join(active.toDF(*key), tiles.TILE).groupBy(*key)).applyInPandas(spread, "pair long, node long, dist double, parent long")
        n += 1
        all_ways = best.unionByName(offers.withColumn("round", F.lit(n))).groupBy("pair", "node").agg(F.min(F.struct("dist", "parent", "round")).alias("o"))
        best = cut(all_ways.select("pair", "node", "o.*"))
    return best.drop("round")


def sweep(sources: DataFrame, links: DataFrame, limit: float = float("inf")) -> DataFrame:
    """(node, dist, parent): least cost from any source (node) to each node, below ``limit``; ties to the smaller parent."""
    return relax(sources.select(F.lit(0).cast("long").alias("pair"), "node"), links, limit).drop("pair")


def route(swept: DataFrame, end: int | None, most: int = 100_000) -> DataFrame:
    """(seq, node) from the source to ``end`` along parents; empty where ``end`` wasn't reached or there is none.

    The predecessor table stays distributed; every round joins the ends of path pieces with pieces twice as long
    (pointer doubling), so the rounds are few.
    """
    jump = cut(swept.select("node", "parent"))
    path = cut(swept.where(F.col("node") == F.lit(end)).select("node", F.lit(0).alias("back")))
    reach = 1
    while reach < most:
        ahead = path.join(jump, "node").where(F.col("parent").isNotNull()).select(F.col("parent").alias("node"), (F.col("back") + reach).alias("back"))
        if ahead.isEmpty():
            break
        path = cut(path.unionByName(ahead))
        jump = cut(jump.join(jump.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent").select("node", F.col("next").alias("parent")))
        reach *= 2
    last = path.agg(F.max("back").alias("m"))
    return path.join(F.broadcast(last)).select((F.col("m") - F.col("back")).alias("seq"), "node")  # one row


def brush(samples: DataFrame, centerline: DataFrame, spacing: tuple[float, float, float], core: float, width: float) -> DataFrame:
    """(x, y, z, dist, weight): samples within core + width of a centreline (x, y, z) along the surface."""
    links = cut(cost_graph(samples, spacing))
    near = sweep(centerline.select(pack_key(*map(F.col, KEY)).alias("node")), links, core + width)
    keyed = samples.select(*KEY, pack_key(*map(F.col, KEY)).alias("node"))
    return keyed.join(near, "node").select(*KEY, "dist", g.falloff(F.col("dist"), core, width).alias("weight"))


def routes(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(pair, seq, node): the cheapest route of each pair (pair, start, end), from its start; no row where there is none.

    All pairs relax in the same rounds, and their ways are walked back together, by pieces of doubling length.
    """
    ends = pairs.select("pair", F.col("end").alias("node"))
    best = relax(pairs.select(F.col("pair").cast("long").alias("pair"), F.col("start").alias("node")), links, ends=ends)
    jump = best.where("parent IS NOT NULL").select("pair", "node", "parent")
    path, reach = cut(best.join(ends, ["pair", "node"]).select("pair", "node", F.lit(0).cast("long").alias("back"))), 1
    while True:
        ahead = cut(path.join(jump, ["pair", "node"]).select("pair", F.col("parent").alias("node"), (F.col("back") + reach).alias("back")))
        if ahead.isEmpty():
            break
        path, reach = cut(path.unionByName(ahead)), reach * 2
        jump = cut(jump.join(jump.select("pair", F.col("node").alias("parent"), F.col("parent").alias("next")), ["pair", "parent"]).select("pair", "node", F.col("next").alias("parent")))
    last = path.groupBy("pair").agg(F.max("back").alias("m"))
    return path.join(last, "pair").select("pair", (F.col("m") - F.col("back")).alias("seq"), "node")


def anchors(grid: Grid, path: DataFrame, surface: DataFrame, search: float) -> DataFrame:
    """(seq, node): for each point of ``path`` (seq, wx, wy, wz) the nearest surface place within ``search``.

    Points without one give no row, and of points in a row with the same place only the first does. Equal distances go
    to the first by (z, y, x). One stroke's points are ordered in one window.
    """
    index = g.to_index(grid, F.col("wx"), F.col("wy"), F.col("wz"))
    around = path.select("seq", "wx", "wy", "wz", *[F.floor(c).cast("int").alias(f"_{k}") for c, k in zip(index, KEY, strict=True)])
    for k, s in zip(KEY, grid.spacing, strict=True):
        r = math.ceil(search / s)
        around = around.withColumn(k, F.explode(F.sequence(F.col(f"_{k}") - r, F.col(f"_{k}") + r)))
    met = around.join(surface.select(*KEY), KEY)
    there = g.to_world(grid, *map(F.col, KEY))
    away = g.length(g.minus(there, g.vector("wx", "wy", "wz")))
    nearest = met.withColumn("d", away).where(F.col("d") <= search).groupBy("seq").agg(F.min(F.struct("d", "z", "y", "x")).alias("o"))
    found = nearest.select("seq", pack_key(F.col("o.x"), F.col("o.y"), F.col("o.z")).alias("node"))
    before = F.lag("node").over(Window.orderBy("seq"))
    return found.withColumn("_before", before).where("_before IS NULL OR _before <> node").drop("_before")


def stroke(grid: Grid, path: DataFrame, settings: BrushSettings) -> tuple[DataFrame, DataFrame]:
    """(samples, centreline) of a brush along ``path`` (seq, wx, wy, wz); both empty where no point meets the surface.

    samples: x, y, z, wx, wy, wz, nx, ny, nz, deviation, planarity, dist, weight of all surface places nearer than core +
    width to the centreline along the surface. centreline: piece, seq, x, y, z; the routes between anchors, where an
    anchor that can't be reached from the one before begins a new piece. Only voxels of the path's padded box are read.
    """
    widest = max(grid.spacing)
    radius = settings.planarity_radius or 2 * widest
    search = settings.search or math.hypot(*grid.spacing)
    outer = settings.core + settings.width
    padded = outer + radius + 2 * widest
    index = dict(zip(KEY, g.to_index(grid, F.col("wx"), F.col("wy"), F.col("wz")), strict=True))
    ends = path.agg(*[f(index[k]).alias(f"{n}{k}") for k in KEY for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends["lowx"] is None:
        raise ValueError("a stroke needs a point")
    low = tuple(math.floor(ends[f"low{k}"] - padded / s) for k, s in zip(KEY, grid.spacing, strict=True))
    high = tuple(math.ceil(ends[f"high{k}"] + padded / s) for k, s in zip(KEY, grid.spacing, strict=True))
    surface = cut(tiles.skin(grid, settings.iso, radius, settings.angular_scale, low, high))
    links = cut(cost_graph(surface, grid.spacing, settings.plane_penalty, settings.normal_penalty, settings.normal_scale))
    order = Window.orderBy("seq")
    named = cut(anchors(grid, path, surface, search).withColumn("pair", F.row_number().over(order)).withColumn("start", F.lag("node").over(order)))
    ways = cut(routes(named.where("start IS NOT NULL").select("pair", "start", F.col("node").alias("end")), links))
    # An anchor without a way from the one before begins a piece; of a way all but its first node follow.
    joined = ways.where("seq > 0").select("pair", "seq", "node")
    begins = named.join(ways.select("pair").distinct(), "pair", "left_anti").select("pair", F.lit(0).cast("long").alias("seq"), "node")
    firsts = named.join(begins.select("pair", F.lit(1).alias("new")), "pair", "left").select("pair", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("pair")).alias("piece"))
    line = cut(begins.unionByName(joined).join(firsts, "pair"))
    placed = [c.alias(k) for c, k in zip(unpack_key(F.col("node")), KEY, strict=True)]
    centreline = line.select("piece", (F.row_number().over(Window.partitionBy("piece").orderBy("pair", "seq")) - 1).alias("seq"), *placed)
    near = sweep(line.select("node"), links, outer)
    reached = surface.withColumn("node", pack_key(*map(F.col, KEY))).join(near, "node")
    world = [c.alias(n) for c, n in zip(g.to_world(grid, *map(F.col, KEY)), ("wx", "wy", "wz"), strict=True)]
    weight = F.lit(float(settings.strength)) * g.falloff(F.col("dist"), settings.core, settings.width)
    return reached.select(*KEY, *world, "nx", "ny", "nz", "deviation", "planarity", "dist", weight.alias("weight")), centreline


def mean_planarity(samples: DataFrame) -> DataFrame:
    """One row (n, mean_planarity) over the samples of a stroke; 0 where it has none."""
    return samples.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("planarity").cast("double")), F.lit(0.0)).alias("mean_planarity"))
