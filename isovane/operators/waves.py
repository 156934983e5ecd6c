"""Wavefronts over samples, many levels at a time: tiles with a deep halo.

What a level decides about a sample depends on its 26 neighbours alone. A tile that also has the samples up to
``LEVELS`` places around it can therefore work out so many levels of its own samples exactly, without any other tile. A round
hands each tile that the front can reach its samples and what is known of them, runs ``LEVELS`` levels in each
task, and keeps the rows of the tile itself. Jobs follow levels / LEVELS; tiles away from the front are not grouped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isovane.functions.geometry import TINY
from isovane.operators.stencil import KEY, box
from isovane.operators.tiles import TILE, tiled
from isovane.plans.lineage import cut

SIDE = 32
LEVELS = 16
OFFSETS = np.array(box(1))
NEVER = -1


def packed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The long key of integer places, as target.pack_key() makes it."""
    half = 1 << 20
    return ((x.astype(np.int64) + half) << 42) | ((y.astype(np.int64) + half) << 21) | (z.astype(np.int64) + half)


class Cloud:
    """Samples of a tile and its halo in order of key: places, axes, and for each the numbers of its 26 neighbours.

    ``near[i, d]`` is the sample at place i - offset d, from which step d leads to i; NEVER where there is none.
    """

    def __init__(self, frame: pd.DataFrame, spacing: tuple[float, float, float]) -> None:
        at = frame[KEY].to_numpy(np.int64)
        self.key = packed(*at.T)
        order = np.argsort(self.key)
        self.key, self.at = self.key[order], at[order]
        self.axis = frame[["nx", "ny", "nz"]].to_numpy(float)[order]
        self.step = OFFSETS * np.array(spacing, float)
        self.d2 = (OFFSETS**2).sum(1).astype(float)
        self.near = np.stack([self.find(packed(*(self.at - o).T)) for o in OFFSETS], 1) if len(at) else np.zeros((0, len(OFFSETS)), int)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Sample numbers of keys, NEVER for keys without a sample."""
        if not len(self.key):
            return np.full(len(keys), NEVER)
        i = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[i] == keys, i, NEVER)

    def aligned(self) -> np.ndarray:
        """Inner products of the axes of each sample and its neighbours; 0 where there is none."""
        return np.where(self.near >= 0, np.einsum("ik,idk->id", self.axis, self.axis[self.near]), 0.0)

    def continues(self, theirs: np.ndarray, mine: np.ndarray, most: float) -> np.ndarray:
        """(sample, offset): whether the step from a neighbour with axis ``theirs`` stays near the tangent planes of both."""
        long = lambda v: np.sqrt((v * v).sum(-1))
        a, b, s = long(theirs), long(mine), long(self.step)
        good = (self.near >= 0) & (a * a > TINY) & (b * b > TINY)[:, None]
        one = np.abs(np.einsum("dk,idk->id", self.step, theirs)) / np.where(a > 0, a * s, 1.0)
        two = np.abs(mine @ self.step.T) / np.where(b > 0, b, 1.0)[:, None] / s
        return good & (np.maximum(one, two) <= most)


def spread(samples: DataFrame, first: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame, int, int], pd.DataFrame], enough: Callable[[DataFrame], bool] | None = None, levels: int = LEVELS, side: int = SIDE) -> DataFrame:
    """All rows that a front reaches: ``first`` (x, y, z, depth 0, state), then what ``step`` adds batch by batch.

    ``step`` gets the samples of a tile with its halo, what is known there, the level that has been reached and the number
    of levels to go, and returns rows like ``first`` with larger depths (or a null depth for remarks that spread nothing); those of the
    halo are left out. ``enough`` may end the rounds early, given all rows so far.
    """
    renamed = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides may come from the same rows
    ground = renamed(cut(tiled(samples, levels, side)))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in first.schema])
    done, level, rounds = cut(first), 0, 0
    front = done

    names = schema.names

    def batch(reached: int) -> Callable:
        def run(key: tuple, cloud: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            out = step(cloud, known, reached, levels) if len(cloud) and len(known) else pd.DataFrame()
            if not len(out):
                return pd.DataFrame({n: [] for n in names})
            return out.loc[np.all(out[KEY].to_numpy(np.int64) // side == np.array(key), axis=1), names]

        return run

    while not front.isEmpty() and not (enough and enough(done)):
        active = cut(tiled(front.select(*KEY), levels, side).select(*TILE).distinct())
        cloud = ground.join(active, TILE, "left_semi")
        known = renamed(tiled(done, levels, side)).join(renamed(active), TILE, "left_semi")
        fresh = cut(cloud.groupBy(*TILE).cogroup(known.groupBy(*TILE)).applyInPandas(batch(level), schema))
        level, rounds = level + levels, rounds + 1
        done = done.unionByName(fresh)
        done = cut(done) if rounds % 8 == 0 else done
        front = fresh.where(F.col("depth") == level)
    return done


def signs(spacing: tuple[float, float, float], min_alignment: float, max_component: float) -> Callable[[pd.DataFrame, pd.DataFrame, int, int], pd.DataFrame]:
    """Levels in which samples get the sign that two neighbours (one beside the seed) vote for clearly.

    The preferred parent: nearest, not turning back, least sideways, most forward, best aligned, smallest key.
    """

    def step(frame: pd.DataFrame, known: pd.DataFrame, level: int, levels: int) -> pd.DataFrame:
        c = Cloud(frame, spacing)
        a, n = c.aligned(), len(c.key)
        gate = (np.abs(a) >= min_alignment) & c.continues(c.axis[c.near], c.axis, max_component)
        sign, depth, parent, came = np.zeros(n, np.int64), np.full(n, NEVER), np.full(n, NEVER), np.zeros((n, 3), np.int64)
        at = c.find(packed(*known[KEY].to_numpy(np.int64).T))
        sign[at], depth[at], came[at] = known["sign"], known["depth"], known[["ex", "ey", "ez"]]
        weight = a * a / c.d2
        for now in range(level, level + levels):
            todo = np.flatnonzero((gate & (depth[c.near] == now)).any(1) & (depth == NEVER))
            near, open_ = c.near[todo], gate[todo] & (depth[c.near[todo]] != NEVER)
            w = np.where(open_, weight[todo], 0.0)
            vote, total = (w * a[todo] * sign[near]).sum(1), w.sum(1)
            clear = (open_.sum(1) >= (1 if now == 0 else 2)) & (np.abs(vote) >= min_alignment * total) & (total > TINY)
            todo, near, open_, vote = todo[clear], near[clear], open_[clear], vote[clear]
            if not len(todo):
                break
            row, d = np.nonzero(open_)
            u, e = near[row, d], came[near[row, d]]
            along, size = (e * OFFSETS[d]).sum(1), (e * e).sum(1)
            lateral = np.where(size > 0, c.d2[d] - along * along / np.where(size > 0, size, 1), 0.0)
            order = np.lexsort((c.key[u], -np.abs(a[todo[row], d]), -along, lateral, along < 0, c.d2[d], row))
            best = order[np.unique(row[order], return_index=True)[1]]
            sign[todo], depth[todo] = np.where(vote < 0, -1, 1), now + 1
            parent[todo], came[todo] = c.key[u[best]], OFFSETS[d[best]]
        new = depth > level
        return pd.DataFrame({**dict(zip(KEY, c.at[new].T, strict=True)), "sign": sign[new], "depth": depth[new], "parent": parent[new], **dict(zip(("ex", "ey", "ez"), came[new].T, strict=True))})

    return step


def revoted(rows: DataFrame, spacing: tuple[float, float, float], min_alignment: float, max_component: float, passes: int = 2, side: int = SIDE) -> DataFrame:
    """``rows`` (x, y, z, axis, sign, depth, parent) after ``passes`` in which all signs but the seed's follow their neighbours."""
    schema = rows.select(*KEY, "sign", "depth", "parent").schema

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        c = Cloud(frame, spacing)
        a = c.aligned()
        gate = (np.abs(a) >= min_alignment) & c.continues(c.axis[c.near], c.axis, max_component)
        frame = frame.iloc[np.argsort(packed(*frame[KEY].to_numpy(np.int64).T))]
        sign, depth = frame["sign"].to_numpy(np.int64), frame["depth"].to_numpy(np.int64)
        square = np.where(gate, a * a, 0.0)
        total = square.sum(1)
        for _ in range(passes):
            vote = (square * a * sign[c.near]).sum(1)
            clear = (np.abs(vote) >= min_alignment * total) & (total > TINY) & (depth > 0)
            sign = np.where(clear, np.where(vote < 0, -1, 1), sign)
        own = np.all(c.at // side == np.array(key), axis=1)
        out = frame[[*KEY, "depth", "parent"]].assign(sign=sign)
        return out.loc[own, [*KEY, "sign", "depth", "parent"]]

    # pandas would read longs among nulls as doubles
    whole = rows.withColumn("parent", F.coalesce("parent", F.lit(NEVER)))
    found = tiled(whole, passes, side).groupBy(*TILE).applyInPandas(run, schema)
    return found.withColumn("parent", F.when(F.col("parent") != NEVER, F.col("parent")))


def carried(spacing: tuple[float, float, float], max_component: float) -> Callable[[pd.DataFrame, pd.DataFrame, int, int], pd.DataFrame]:
    """Levels in which samples turn to the side of a neighbour that has one; of several the smallest key leads."""

    def step(frame: pd.DataFrame, known: pd.DataFrame, level: int, levels: int) -> pd.DataFrame:
        c = Cloud(frame, spacing)
        n = len(c.key)
        axis, depth, parent = np.zeros((n, 3)), np.full(n, NEVER), np.full(n, NEVER)
        at = c.find(packed(*known[KEY].to_numpy(np.int64).T))
        axis[at], depth[at] = known[["ox", "oy", "oz"]], known["depth"]
        for now in range(level, level + levels):
            front = (c.near >= 0) & (depth[c.near] == now) & (depth == NEVER)[:, None]
            source = axis[c.near]
            side = np.where(np.einsum("ik,idk->id", c.axis, source) < 0, -1.0, 1.0)
            front &= c.continues(source, c.axis, max_component)
            row, d = np.nonzero(front)
            if not len(row):
                break
            order = np.lexsort((c.key[c.near[row, d]], row))
            best = order[np.unique(row[order], return_index=True)[1]]
            row, d = row[best], d[best]
            axis[row], depth[row], parent[row] = c.axis[row] * side[row, d][:, None], now + 1, c.key[c.near[row, d]]
        new = depth > level
        return pd.DataFrame({**dict(zip(KEY, c.at[new].T, strict=True)), **dict(zip(("ox", "oy", "oz"), axis[new].T, strict=True)), "depth": depth[new], "parent": parent[new]})

    return step


REASONS = ("invalid", "discontinuous", "weak", "distance", "aligned")


def chain(start: tuple[int, int, int], spacing: tuple[float, float, float], most_mm: float, min_alignment: float, max_component: float, traced: bool) -> Callable[[pd.DataFrame, pd.DataFrame, int, int], pd.DataFrame]:
    """Levels of a flip: samples that turn with their parent, and with a null depth those at which it stops, by number of reason.

    With ``traced`` the samples have a column ``leader``, NEVER for none: only it may turn them.
    """

    def step(frame: pd.DataFrame, known: pd.DataFrame, level: int, levels: int) -> pd.DataFrame:
        c = Cloud(frame, spacing)
        n, a = len(c.key), c.aligned()
        far = (((c.at - np.array(start)) * np.array(spacing) * 1000.0) ** 2).sum(1) > most_mm**2 if most_mm > 0 else np.zeros(n, bool)
        empty = (c.axis**2).sum(1) <= TINY
        tests = (np.broadcast_to(empty[:, None], a.shape), ~c.continues(c.axis[c.near], c.axis, max_component), np.abs(a) < min_alignment, np.broadcast_to(far[:, None], a.shape), a <= -min_alignment)
        reason = np.select(tests, range(1, 6), 0)
        allowed = c.near >= 0
        if traced:
            leader = frame["leader"].to_numpy(np.int64)[np.argsort(packed(*frame[KEY].to_numpy(np.int64).T))]
            allowed &= c.key[c.near] == leader[:, None]
        depth, parent = np.full(n, NEVER), np.full(n, NEVER)
        known = known[known["depth"].notna()]
        depth[c.find(packed(*known[KEY].to_numpy(np.int64).T))] = known["depth"]
        stops = np.full(n, len(REASONS) + 1)
        for now in range(level, level + levels):
            met = allowed & (depth[c.near] == now) & (depth == NEVER)[:, None]
            if not met.any():
                break
            stops = np.minimum(stops, np.where(met & (reason > 0), reason, len(REASONS) + 1).min(1))
            goes = np.where(met & (reason == 0), c.key[c.near], np.iinfo(np.int64).max).min(1)
            turned = goes < np.iinfo(np.int64).max
            depth[turned], parent[turned] = now + 1, goes[turned]
        new, end = depth > level, stops <= len(REASONS)
        rows = pd.DataFrame({**dict(zip(KEY, c.at[new].T, strict=True)), "depth": pd.array(depth[new], "Int64"), "parent": pd.array(parent[new], "Int64"), "stop": pd.array([pd.NA] * int(new.sum()), "Int64")})
        ends = pd.DataFrame({**dict(zip(KEY, c.at[end].T, strict=True)), "depth": pd.array([pd.NA] * int(end.sum()), "Int64"), "parent": pd.array([pd.NA] * int(end.sum()), "Int64"), "stop": pd.array(stops[end], "Int64")})
        return pd.concat([rows, ends], ignore_index=True)

    return step
