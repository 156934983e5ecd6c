"""Painted strokes as event tables: spacing, slices, weights, and their merge into a weight field."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stroke_events(events: DataFrame) -> DataFrame:
    """(stroke_id, seq, ms, wx, wy, wz): the events of a user in order, with the time since the first."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("_ms")
    at = events.select(F.col("user_id").alias("stroke_id"), "user_id", "ts", "event_id", ms, (F.col("value") % 97).alias("wx"), (F.col("event_id") % 53 / 10.0).alias("wy"), F.lit(0.0).alias("wz"))
    return at.select("stroke_id", F.row_number().over(order).alias("seq"), (F.col("_ms") - F.first("_ms").over(order)).alias("ms"), "wx", "wy", "wz")


def changed_only(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows that differ from the one before in any of ``columns``; the first of each key stays."""
    w = Window.partitionBy(key).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def growing_slices(fits: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """(key, order, from, to): what each fit adds: from one before the previous count to its own; equal counts add nothing.

    A count that falls is an error of the log: ``valid`` is false from there on.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.lag(count).over(w), F.lit(0))
    top = F.max(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    staged = fits.select(key, order, F.greatest(before - 1, F.lit(0)).alias("from"), F.col(count).alias("to"), before.alias("_b"), top.alias("_top"))
    return staged.where(F.col("to") != F.col("_b")).select(key, order, "from", "to", (F.col("to") >= F.col("_top")).alias("valid"))


def spaced(points: DataFrame, least: float) -> DataFrame:
    """Points (stroke_id, seq, wx, wy, wz) at least ``least`` from the last one kept, in seq order.

    A fold over each stroke's points: the decision depends on the last kept point, which no window frame can say. Rows
    come sorted by stroke and pass in batches, and only the last kept point is held, so a stroke of any length (a null
    id is one too) needs no more memory than others. A first point stays; others with a null place don't.
    """
    names = ["stroke_id", "seq", "wx", "wy", "wz"]
    marked = points.select(*names, (F.row_number().over(Window.partitionBy("stroke_id").orderBy("seq")) == 1).alias("_first"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)
        for batch in batches:
            keep = []
            for first, *p in zip(*[batch[c].to_pylist() for c in ("_first", "wx", "wy", "wz")], strict=True):
                far = first or (None not in (*p, *last) and sum((a - b) * (a - b) for a, b in zip(p, last, strict=True)) >= least * least)
                keep.append(far)
                last = tuple(p) if far else last
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return marked.mapInArrow(fold, points.select(*names).schema)


def merge_weights(*fields: DataFrame) -> DataFrame:
    """(x, y, z, weight): the largest weight of each voxel; weights that are not above 0 or not finite are left out.

    Merging again changes nothing, in any order, so batches may be replayed.
    """
    rows = fields[0].select("x", "y", "z", "weight")
    for f in fields[1:]:
        rows = rows.unionByName(f.select("x", "y", "z", "weight"))
    good = (F.col("weight") > 0) & (F.col("weight") < float("inf")) & ~F.isnan("weight")
    return rows.where(good).groupBy("x", "y", "z").agg(F.max("weight").alias("weight"))


def totals(strokes: DataFrame) -> DataFrame:
    """(stroke_id, points, length, seconds) of each stroke."""
    w = Window.partitionBy("stroke_id").orderBy("seq")
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ("wx", "wy", "wz")))
    return strokes.withColumn("_step", F.coalesce(step, F.lit(0.0))).groupBy("stroke_id").agg(F.count("*").alias("points"), F.sum("_step").alias("length"), (F.max("ms") / 1000.0).alias("seconds"))


def guarded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``rows``, or an error if there are more than ``most``: a limit that never drops rows."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def voxel_of(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)) + 0.5).cast("int")
