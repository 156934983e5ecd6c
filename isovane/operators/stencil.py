"""Neighbour lookups in sparse grids: equi-joins and grouped sums on keys shifted by a fixed set of offsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offset = tuple[int, int, int]
KEY = ["x", "y", "z"]

SIX: list[Offset] = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def box(radius: int, center: bool = False) -> list[Offset]:
    """All offsets of a cube, in (dx, dy, dz) order; 26 of them for radius 1."""
    side = range(-radius, radius + 1)
    return [o for o in product(side, side, side) if center or any(o)]


def half_box() -> list[Offset]:
    """13 of the 26 neighbours: each undirected edge once."""
    return [o for o in box(1) if o > (0, 0, 0)]


def diamond(layers: int, center: bool = False) -> list[Offset]:
    """Offsets within L1 distance ``layers``."""
    return [o for o in box(layers, center) if sum(map(abs, o)) <= layers]


def offsets_column(offsets: list[Offset]) -> Column:
    """The offsets as an array of (slot, dx, dy, dz), to be exploded."""
    return F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for i, (a, b, c) in enumerate(offsets)])


def shifted(df: DataFrame, offsets: list[Offset], sign: int = 1, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Each row once for each offset: its columns, ``slot``, dx, dy, dz, and (qx, qy, qz) = key + sign * offset."""
    each = df.withColumn("_o", F.explode(offsets_column(offsets)))
    moved = [(F.col(n) + F.lit(sign) * F.col(f"_o.{d}")).alias(q) for n, d, q in zip(names, ("dx", "dy", "dz"), ("qx", "qy", "qz"), strict=True)]
    return each.select(*[F.col(c) for c in df.columns], "_o.slot", "_o.dx", "_o.dy", "_o.dz", *moved)


def neighbours(df: DataFrame, other: DataFrame, offsets: list[Offset], how: str = "inner") -> DataFrame:
    """Rows of ``df`` beside the rows of ``other`` at key + offset; columns of ``other`` get the prefix "n_".

    ``df`` is multiplied by the number of offsets and shuffled with ``other`` on the shifted key, so filter both
    before. ``how`` may be inner, left or left_semi.
    """
    right = other.select(*[F.col(k).alias(q) for k, q in zip(KEY, ("qx", "qy", "qz"), strict=True)], *[F.col(c).alias(f"n_{c}") for c in other.columns if c not in KEY])
    return shifted(df, offsets).join(right, ["qx", "qy", "qz"], how)


def gather(samples: DataFrame, values: DataFrame, offsets: list[Offset], background: float, value: str = "value", prefix: str = "v") -> DataFrame:
    """``samples`` with one column for each offset: the value at key + offset, or the background."""
    found = neighbours(samples.select(*KEY), values.select(*KEY, value), offsets, "left")
    slots = [F.max(F.when(F.col("slot") == i, F.col(f"n_{value}"))).alias(f"{prefix}{i}") for i in range(len(offsets))]
    wide = found.groupBy(*KEY).agg(*slots)
    filled = wide.select(*KEY, *[F.coalesce(f"{prefix}{i}", F.lit(float(background))).alias(f"{prefix}{i}") for i in range(len(offsets))])
    return samples.join(filled, KEY)


def count_neighbours(rows: DataFrame, offsets: list[Offset]) -> DataFrame:
    """(x, y, z, n): for every place next to some row, how many of its offsets lead to one. Partial sums, no join."""
    return shifted(rows.select(*KEY), offsets, -1).groupBy(F.col("qx").alias("x"), F.col("qy").alias("y"), F.col("qz").alias("z")).agg(F.count("*").alias("n"))


def cell_of(position: Column, size: float) -> Column:
    return F.floor(position / F.lit(float(size))).cast("long")


def radius_join(queries: DataFrame, points: DataFrame, radius: float, names: tuple[str, str, str] = ("wx", "wy", "wz"), prefix: str = "p_") -> DataFrame:
    """Rows of both within ``radius``, with ``d2``, the squared distance.

    Points are binned into cells of side ``radius``; a query looks into the 27 cells around its own, and exact
    distances decide. Columns of ``points`` get ``prefix``.
    """
    cells = [cell_of(F.col(n), radius).alias(c) for n, c in zip(names, ("x", "y", "z"), strict=True)]
    binned = points.select(*[cell_of(F.col(n), radius).alias(c) for n, c in zip(names, ("qx", "qy", "qz"), strict=True)], *[F.col(c).alias(prefix + c) for c in points.columns])
    looking = shifted(queries.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(cells)]), box(1, center=True), 1, ("_c0", "_c1", "_c2")).drop("_c0", "_c1", "_c2", "slot", "dx", "dy", "dz")
    d2 = sum((F.col(n) - F.col(prefix + n)) * (F.col(n) - F.col(prefix + n)) for n in names)
    return looking.join(binned, ["qx", "qy", "qz"]).drop("qx", "qy", "qz").withColumn("d2", d2).where(F.col("d2") <= F.lit(float(radius) ** 2))
