"""Stroke events as streams: spacing by state per stroke, tail recomputation, and idempotent weight merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.operators.strokes import merge_weights

KEPT = "stroke_id long, seq long, wx double, wy double, wz double"
_STATE = "wx double, wy double, wz double, kept long"


def spaced_stream(points: DataFrame, least: float) -> DataFrame:
    """Points (stroke_id, seq, wx, wy, wz) of a stream at least ``least`` from the last one kept of their stroke.

    The last kept point is the state of a stroke, so a stream in any batches keeps what one batch would, as long as a
    stroke's points arrive in order. Run it with append output.
    """

    def each(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        kept = []
        for seq, *p in rows[["seq", "wx", "wy", "wz"]].itertuples(index=False):
            if last is None or sum((a - b) ** 2 for a, b in zip(p, last[:3], strict=True)) >= least * least:
                last = (*map(float, p), (last[3] if last else 0) + 1)
                kept.append((key[0], int(seq), *map(float, p)))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=["stroke_id", "seq", "wx", "wy", "wz"])

    return points.groupBy("stroke_id").applyInPandasWithState(each, KEPT, _STATE, "append", "NoTimeout")


def refit_every(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, milliseconds: int | None = 120):
    """Start ``action`` on each micro-batch, at most every 120 ms; with None all that is there at once, then end."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{milliseconds} milliseconds") if milliseconds else writer.trigger(availableNow=True)).start()


class WeightField:
    """A weight field in Parquet, one folder for each batch number; a replayed batch overwrites its own folder.

    Reading takes the largest weight of each voxel over all folders, so replays change nothing.
    """

    def __init__(self, path: str):
        self.path = path

    def merge(self, weights: DataFrame, batch: int) -> None:
        merge_weights(weights).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, spark) -> DataFrame:
        return merge_weights(spark.read.parquet(self.path))


def tails(points: DataFrame, fitted: DataFrame) -> DataFrame:
    """Points of each stroke from one before the fitted count on: what a refit needs."""
    done = points.join(fitted.select("stroke_id", "n_fitted"), "stroke_id", "left")
    return done.where(F.col("seq") >= F.coalesce("n_fitted", F.lit(0))).drop("n_fitted")


def per_minute(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of values by time window and type; an addition for event tables. Zone-less times count as UTC."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
