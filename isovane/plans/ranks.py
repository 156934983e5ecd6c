"""Places in a global order, without a task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each row in the whole order, from 0; rows that tie share places in any way.

    Rows are range-partitioned and sorted once and written to the checkpoint folder with their place in their part.
    The counts of the parts, a row for each, give the offsets. Columns _at, _part and _start must not be in ``rows``.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select("_part", (F.sum("n").over(running) - F.col("n")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_at", "_part", "_start")
