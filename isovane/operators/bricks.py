"""Grids as 8 x 8 x 8 bricks: fixed arrays of values, bit masks of active voxels, Morton order, neighbour ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators.stencil import box, shifted
from isovane.operators.target import pack_key
from isovane.plans.lineage import cut
from isovane.sources.voxels import FOG, Grid

SIDE = 8
CELLS = SIDE**3
SLOTS = box(1)
NONE = (1 << 32) - 1
BASE = ["bi", "bj", "bk"]


def leaf_keys(voxels: DataFrame) -> DataFrame:
    """``voxels`` with their brick (bi, bj, bk: floor(x / 8)) and their place in it, z fastest."""
    low = lambda c: F.pmod(F.col(c), F.lit(SIDE))
    return voxels.select("*", *[F.expr(f"shiftright({k}, 3)").alias(b) for k, b in zip("xyz", BASE, strict=True)], (low("x") * 64 + low("y") * 8 + low("z")).alias("cell"))


def leaves(voxels: DataFrame) -> DataFrame:
    """(bi, bj, bk, n, active): bricks that hold any voxel."""
    return leaf_keys(voxels).groupBy(*BASE).agg(F.count("*").alias("n"), F.count_if("active").alias("active"))


def from_grid(grid: Grid) -> DataFrame:
    """One row for each brick: origin, Morton key, active count, 512 values, 8 mask words, in Morton order.

    A brick's rows are at most 512, so its arrays are bounded. Level sets and spans beyond 21 bits are refused.
    """
    if grid.grid_class != FOG:
        raise ValueError("bricks take fog volumes only")
    keyed = leaf_keys(grid.voxels)
    packed = keyed.groupBy(*BASE).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct(F.col("value").cast("float").alias("value"), "active")))).alias("m"), F.count_if("active").cast("int").alias("active_count"))
    low = keyed.agg(*[F.min(b).alias(b) for b in BASE], *[(F.max(b) - F.min(b)).alias(f"s{b}") for b in BASE]).first()
    if low[0] is not None and max(low[3:]) > (1 << 21) - 1:
        raise ValueError("the grid spans more than 2^21 bricks along an axis")
    start = [int(low[i] or 0) for i in range(3)]
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    values = F.transform(cells, lambda i: F.coalesce(F.col("m")[i]["value"], F.lit(grid.background).cast("float")))
    bit = lambda i: F.when(F.coalesce(F.col("m")[i]["active"], F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("long")
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(w * 64 + b), b)))
    key = g.morton(*[F.col(b) - F.lit(s) for b, s in zip(BASE, start, strict=True)])
    rows = packed.select(*BASE, key.alias("morton"), "active_count", values.alias("vals"), F.transform(F.sequence(F.lit(0), F.lit(7)), word).alias("words"))
    return rows.withColumnRenamed("vals", "cells").repartitionByRange("morton").sortWithinPartitions("morton")


def is_active(bricks: DataFrame, cell: int) -> DataFrame:
    """Bit test of one place of every brick."""
    return bricks.select(*BASE, F.getbit(F.element_at("words", cell // 64 + 1), F.lit(cell % 64)).cast("boolean").alias("on"))


def to_voxels(bricks: DataFrame, background: float = 0.0) -> DataFrame:
    """(x, y, z, value, active) of all places that are active or not background."""
    cells = bricks.select(*BASE, "words", F.posexplode("cells").alias("cell", "value"))
    on = F.getbit(F.element_at("words", F.shiftright("cell", 6) + 1), F.col("cell") % 64) == 1
    place = [F.col(b) * SIDE + F.shiftright("cell", n).bitwiseAND(F.lit(7)) for b, n in zip(BASE, (6, 3, 0), strict=True)]
    return cells.select(*[p.cast("int").alias(k) for p, k in zip(place, "xyz", strict=True)], F.col("value").cast("double").alias("value"), on.alias("active")).where(F.col("active") | (F.col("value") != background))


def neighbour_table(bricks: DataFrame) -> DataFrame:
    """(bi, bj, bk, slot, neighbour): 26 rows for each brick; an absent neighbour has the id NONE, others their packed key."""
    keys = cut(bricks.select(*BASE))
    there = keys.select(F.col("bi").alias("qx"), F.col("bj").alias("qy"), F.col("bk").alias("qz"), pack_key(F.col("bi"), F.col("bj"), F.col("bk")).alias("id"))
    found = shifted(keys, SLOTS, 1, ("bi", "bj", "bk")).join(there, ["qx", "qy", "qz"], "left")
    return found.select(*BASE, "slot", F.coalesce("id", F.lit(NONE)).alias("neighbour"))


def slot_of(dx: int, dy: int, dz: int) -> int:
    """The slot of a neighbour direction; zero or far directions have none."""
    if (dx, dy, dz) not in SLOTS:
        raise ValueError("not a neighbour direction")
    return SLOTS.index((dx, dy, dz))


def with_neighbours(bricks: DataFrame) -> DataFrame:
    """``bricks`` with their 26 neighbour ids as an array."""
    ids = neighbour_table(bricks).groupBy(*BASE).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "neighbour"))), lambda s: s.neighbour).alias("neighbours"))
    return bricks.join(ids, BASE)


def validate(a: DataFrame, b: DataFrame, background: float = 0.0) -> DataFrame:
    """One row: voxels of ``a`` that ``b`` lacks, extra ones, active and value mismatches, the largest error. NaN equals NaN."""
    left = a.select("x", "y", "z", F.col("value").alias("va"), F.col("active").alias("aa"))
    right = b.select("x", "y", "z", F.col("value").alias("vb"), F.col("active").alias("ab"))
    both = left.join(right, ["x", "y", "z"], "full_outer")
    shared = F.col("aa").isNotNull() & F.col("ab").isNotNull()
    return both.agg(
        F.count_if(F.col("ab").isNull()).alias("missing"), F.count_if(F.col("aa").isNull()).alias("extra"),
        F.count_if(shared & (F.col("aa") != F.col("ab"))).alias("active_mismatch"),
        F.count_if(shared & (F.col("va") != F.col("vb"))).alias("value_mismatch"),
        F.coalesce(F.max(F.when(shared, F.abs(F.col("va") - F.col("vb")))), F.lit(0.0)).alias("max_error"),
    )
