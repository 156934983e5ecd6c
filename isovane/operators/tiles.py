"""Grids cut into tiles with a halo: one shuffle of the voxels, then whole-block arithmetic inside each task.

A voxel goes to its own tile of ``SIDE``^3 places and to those whose halo it is in, so a task holds one bounded block at
a time and needs no other. Each place belongs to one tile, which alone gives its rows. Values must be finite; rows whose
value is null count as absent, as places with the background value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions.geometry import TINY
from isovane.operators.stencil import KEY, box
from isovane.sources.voxels import FOG, Grid

SIDE = 32
TILE = ["tx", "ty", "tz"]
AXES = [(axis, sign) for axis in range(3) for sign in (1, -1)]
CORNERS = list(product((0, 1), repeat=3))
#: The 12 edges of a cell as pairs of corner numbers.
CELL_EDGES = [(i, j) for i, j in product(range(8), repeat=2) if i < j and sum(a != b for a, b in zip(CORNERS[i], CORNERS[j], strict=True)) == 1]


def tiled(rows: DataFrame, halo: int, side: int) -> DataFrame:
    """``rows`` once for each tile (tx, ty, tz) whose halo they are in."""
    for k, t in zip(KEY, TILE, strict=True):
        rows = rows.withColumn(t, F.explode(F.sequence(F.floor((F.col(k) - halo) / side), F.floor((F.col(k) + halo) / side))))
    return rows


@dataclass(frozen=True)
class Rules:
    """What holds for all places of a grid, without its rows."""

    iso: float
    fog: bool
    background: float
    spacing: tuple[float, float, float]
    outward: float

    @staticmethod
    def of(grid: Grid, iso: float) -> Rules:
        return Rules(iso, grid.grid_class == FOG, float(grid.background), grid.spacing, grid.outward())

    def inside(self, value: np.ndarray) -> np.ndarray:
        return value >= self.iso if self.fog else value <= self.iso

    def crossing(self, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Where the value passes iso on the way to a neighbour, 0 to 1; 0.5 where both are equal."""
        step = there - here
        apart = np.abs(step) > 1e-12
        return np.where(apart, np.clip((self.iso - here) / np.where(apart, step, 1.0), 0, 1), 0.5)


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


class Block:
    """A tile and its halo as flat arrays with a margin of one place; places are flat indices."""

    def __init__(self, frame: pd.DataFrame, halo: int, rules: Rules):
        self.rules, self.edge = rules, SIDE + 2 * halo + 2
        self.stride = np.array([self.edge * self.edge, self.edge, 1])
        self.low = frame[TILE].iloc[0].to_numpy(np.int64) * SIDE - halo - 1
        at = (frame[KEY].to_numpy(np.int64) - self.low) @ self.stride
        self.value = np.full(self.edge**3, rules.background)
        self.known, self.active = np.zeros(self.edge**3, bool), np.zeros(self.edge**3, bool)
        self.value[at], self.known[at], self.active[at] = frame["value"], True, frame["active"].fillna(False).astype(bool)
        self.inside = rules.inside(self.value)

        out = np.zeros_like(self.inside)
        for axis, sign in AXES:
            out |= ~np.roll(self.inside, -sign * self.stride[axis])
        self.skin = self.inside & out
        self.core = self.known & self.active & self.skin
        self.halo = halo

    def within(self, ring: int = 0) -> np.ndarray:
        """Mask of the tile's own places, or also those up to ``ring`` places around it."""
        mask = np.zeros((self.edge,) * 3, bool)
        span = slice(self.halo + 1 - ring, self.halo + 1 + SIDE + ring)
        mask[span, span, span] = True
        return mask.ravel()

    def place(self, at: np.ndarray) -> np.ndarray:
        """(3, n) coordinates of flat indices."""
        return np.stack(np.unravel_index(at, (self.edge,) * 3)) + self.low[:, None]

    def layers(self, most: int) -> np.ndarray:
        """0 for core, 1 to ``most`` for outside voxels that many axis steps from one, -1 for all else."""
        layer = np.where(self.core, 0, -1).astype(np.int16)
        outer = self.known & ~self.inside & (self.value != self.rules.background)
        reached = self.core
        for n in range(1, most + 1):
            grown = reached.copy()
            for axis, sign in AXES:
                grown |= np.roll(reached, sign * self.stride[axis])
            layer[grown & ~reached & outer] = n
            reached = grown
        return layer

    def normals(self, at: np.ndarray) -> np.ndarray:
        """(3, n) outward unit normals.

        Core: the mean direction of the trilinear gradients at all crossings (on an axis a cell reduces to its edge; a
        crossing at the voxel itself takes the cell on the positive side). Others: the forward difference. Where that
        vanishes, the central one; zero where both do.
        """
        v, rules = self.value, self.rules
        scale = np.array([rules.outward / s for s in rules.spacing])[:, None]
        here = v[at]
        ahead = np.stack([v[at + s] - here for s in self.stride])
        behind = np.stack([here - v[at - s] for s in self.stride])
        total = np.zeros((3, len(at)))
        for axis, sign in AXES:
            step = sign * self.stride[axis]
            there = v[at + step]
            t = rules.crossing(here, there)
            gradient = np.empty_like(total)
            for a in range(3):
                if a == axis:
                    gradient[a] = np.where((t > 0) & (sign < 0), behind[a], ahead[a])
                else:
                    gradient[a] = ahead[a] + t * (v[at + step + self.stride[a]] - there - ahead[a])
            gradient *= scale
            size = _length(gradient)
            counts = self.inside[at] & ~rules.inside(there) & (size > TINY)
            total += np.where(counts, gradient / np.where(counts, size, 1.0), 0.0)
        first = np.where(self.core[at], total, ahead * scale)
        chosen = np.where(_length(first) > TINY, first, (ahead + behind) * 0.5 * scale)
        size = _length(chosen)
        good = (size > TINY) & (size < np.inf)
        return np.where(good, chosen / np.where(good, size, 1.0), 0.0)

    def central(self, at: np.ndarray) -> np.ndarray:
        """(3, n) outward unit normals by central differences; zero where these vanish."""
        found = np.stack([(self.value[at + k] - self.value[at - k]) * 0.5 * (self.rules.outward / s) for k, s in zip(self.stride, self.rules.spacing, strict=True)])
        size = _length(found)
        good = (size > TINY) & (size < np.inf)
        return np.where(good, found / np.where(good, size, 1.0), 0.0)

    def planarity(self, at: np.ndarray, normal: np.ndarray, radius: float, angular_scale: float, box_radius: int = 1, itself: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(deviation, planarity) of samples from the sign-aligned normals within ``radius``; zero where the normal is.

        ``normal`` holds normals of all places of the block, zero where none counts. ``itself`` counts the centre too, and
        then a sample without a normal is as flat as those around it.
        """
        mine = normal[:, at]
        sums, weights = np.zeros_like(mine), np.zeros(len(at))
        sigma = max(radius * 0.5, 1e-12)
        for offset in box(box_radius, center=itself):
            d2 = sum(o * o * s * s for o, s in zip(offset, self.rules.spacing, strict=True))
            if d2 > radius * radius:
                continue
            theirs = normal[:, at + np.dot(offset, self.stride)]
            weight = np.exp(-d2 * (0.5 / (sigma * sigma))) * (theirs != 0).any(axis=0)
            sums += theirs * np.where((mine * theirs).sum(axis=0) < 0, -weight, weight)
            weights += weight
        some = weights > 0
        resultant = np.where(some, np.clip(_length(sums) / np.where(some, weights, 1.0), 1e-12, 1), 1e-12)
        deviation = np.sqrt(-2.0 * np.log(resultant))
        flat = (1.0 - np.exp(-weights / 3.0)) * np.exp(-((deviation / max(angular_scale, 1e-12)) ** 2))
        held = (mine != 0).any(axis=0) | itself
        return np.where(held, deviation, 0.0), np.where(held, flat, 0.0)


def over_tiles(grid: Grid, iso: float, halo: int, each: Callable[[Block], pd.DataFrame], schema: str) -> DataFrame:
    """The rows that ``each`` makes of every tile's block."""
    rules = Rules.of(grid, iso)
    rows = grid.voxels.where(F.col("value").isNotNull()).select(*KEY, F.col("value").cast("double").alias("value"), "active")
    return tiled(rows, halo, SIDE).groupBy(*TILE).applyInPandas(lambda frame: each(Block(frame, halo, rules)), schema)


def surface(grid: Grid, settings) -> DataFrame:
    """(x, y, z, value, kind, layer, support, nx, ny, nz, deviation, planarity) of all core and transition samples.

    The halo is one place more than the layers, two at least; a block holds (32 + 2 halo + 2)^3 places.
    """
    layers, radius, scale = settings.layers, settings.planarity_radius, settings.angular_scale

    def each(block: Block) -> pd.DataFrame:
        layer, mine = block.layers(layers), block.within()
        at = np.flatnonzero(mine & (layer >= 0))
        core = np.flatnonzero(block.within(1) & block.core)
        normal = np.zeros((3, len(layer)))
        normal[:, core] = block.normals(core)
        deviation, flat = np.zeros(len(at)), np.zeros(len(at))
        held = block.core[at]
        deviation[held], flat[held] = block.planarity(at[held], normal, radius, scale)
        normal[:, at[~held]] = block.normals(at[~held])
        value, place = block.value[at], block.place(at)
        share = 1.0 - layer[at] / float(layers + 1)
        reached = np.clip(value / block.rules.iso, 0, 1) if block.rules.fog and block.rules.iso > TINY else 1.0
        return pd.DataFrame(dict(
            zip(KEY, place.astype(np.int32), strict=True), value=value, kind=np.where(held, "core", "transition"), layer=layer[at],
            support=np.where(held, 1.0, np.clip(share * reached, 0, 1)), **dict(zip(("nx", "ny", "nz"), normal[:, at], strict=True)), deviation=deviation, planarity=flat,
        ))

    schema = "x int, y int, z int, value double, kind string, layer smallint, support double, nx double, ny double, nz double, deviation double, planarity double"
    return over_tiles(grid, settings.iso, max(2, layers + 1), each, schema)


def skin(grid: Grid, iso: float, radius: float, angular_scale: float, low: tuple | None = None, high: tuple | None = None) -> DataFrame:
    """(x, y, z, nx, ny, nz, deviation, planarity) of inside places with an outside axis neighbour, active or not.

    Normals are central differences; planarity is over all such places within ``radius``, the place itself too. With
    ``low`` and ``high`` (x, y, z) only places strictly between them count, and only voxels of that box are read.
    """
    reach = max(int(np.ceil(radius / s)) for s in grid.spacing)
    bounded = grid
    if low is not None:
        bounded = grid.of(grid.voxels.where(reduce(lambda a, b: a & b, [F.col(k).between(int(a), int(b)) for k, a, b in zip(KEY, low, high, strict=True)])))

    def each(block: Block) -> pd.DataFrame:
        near = np.flatnonzero(block.within(reach) & block.skin)
        if low is not None:
            place = block.place(near)
            near = near[((place > np.array(low)[:, None]) & (place < np.array(high)[:, None])).all(axis=0)]
        normal = np.zeros((3, len(block.value)))
        normal[:, near] = block.central(near)
        at = near[block.within()[near]]
        deviation, flat = block.planarity(at, normal, radius, angular_scale, reach, itself=True)
        return pd.DataFrame(dict(zip(KEY, block.place(at).astype(np.int32), strict=True), **dict(zip(("nx", "ny", "nz"), normal[:, at], strict=True)), deviation=deviation, planarity=flat))

    return over_tiles(bounded, iso, reach + 1, each, "x int, y int, z int, nx double, ny double, nz double, deviation double, planarity double")


def net(grid: Grid, iso: float) -> DataFrame:
    """(x, y, z, slot, px, py, pz): cells of a surface net with their vertex in index space (slot -1), and crossings
    (x, y, z, slot from 0) of core voxels in the order +x, -x, +y, -y, +z, -z."""

    def each(block: Block) -> pd.DataFrame:
        mine, v = block.within(), block.value
        shifts = np.array(CORNERS) @ block.stride
        touched = np.zeros_like(mine)
        for s in shifts:
            touched |= np.roll(block.core, -s)
        cells = np.flatnonzero(mine & touched)
        n, total = np.zeros(len(cells)), np.zeros((3, len(cells)))
        for i, j in CELL_EDGES:
            a, b = cells + shifts[i], cells + shifts[j]
            crossed = block.inside[a] != block.inside[b]
            t = block.rules.crossing(v[a], v[b])
            n += crossed
            for axis in range(3):
                total[axis] += np.where(crossed, CORNERS[i][axis] + t * (CORNERS[j][axis] - CORNERS[i][axis]), 0.0)
        kept = n > 0
        cells, middle = cells[kept], total[:, kept] / n[kept]
        core = np.flatnonzero(mine & block.core)
        out = [(cells, -1, middle)]
        for slot, (axis, sign) in enumerate(AXES):
            over = core[~block.inside[core + sign * block.stride[axis]]]
            out.append((over, slot, np.full((3, len(over)), np.nan)))
        at = block.place(np.concatenate([o[0] for o in out]))
        place = np.concatenate([o[2] for o in out], axis=1) + at
        return pd.DataFrame(dict(zip(KEY, at.astype(np.int32), strict=True), slot=np.concatenate([np.full(len(o[0]), o[1], np.int32) for o in out]), **dict(zip(("px", "py", "pz"), place, strict=True))))

    return over_tiles(grid, iso, 2, each, "x int, y int, z int, slot int, px double, py double, pz double")
