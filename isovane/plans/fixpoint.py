"""Connected components and bounded relaxation loops over edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.plans.lineage import cut

MOST_ROUNDS = 200
#: Edges of a round stand in as many partitions as they need, by their count; at least so many.
EDGES_A_PART = 50_000
LEAST_PARTS = 8
#: Up to so many edges the minima of their nodes are broadcast.
BROADCAST_EDGES = 50_000


def fixpoint(
    state: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    measure: Callable[[DataFrame], tuple],
    max_rounds: int = 10_000,
) -> tuple[DataFrame, int]:
    """Apply ``step`` until ``measure`` (a small tuple of aggregates) stops changing.

    Every round is cut to the checkpoint folder, so plans stay one round long.
    """
    state = cut(state)
    before = measure(state)
    for n in range(1, max_rounds + 1):
        state = cut(step(state, n))
        now = measure(state)
        if now == before:
            return state, n
        before = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _open_nodes(edges: DataFrame, parts: int) -> int:
    """How many nodes keep ``edges`` from being stars: they hang below two others, or below one and above another."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    by_node = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.sum("e.down").alias("downs"))
    return by_node.coalesce(parts).agg(F.count_if((F.col("ups") > 1) | (F.col("ups") > 0) & (F.col("downs") > 0))).first()[0]


def _star_round(edges: DataFrame, parts: int, small: bool = False) -> DataFrame:
    """One large-star and one small-star step: edges (u, v), u > v, hang ever closer under minima.

    Aggregates and equi-joins only: a hub's neighbours are never gathered in one place. ``parts``: as many as the edges need, as a
    round has several shuffles of its own; ``small``: few enough edges to broadcast.
    """
    sent = F.broadcast if small else lambda rows: rows
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = edges.select(ways.alias("e")).select("e.u", "e.v")
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts).select("u", F.least("m", "u").alias("m"))
    large = both.join(sent(lowest), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
    lowest = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
    moved = large.join(sent(lowest), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().coalesce(parts)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in an edge; the component is its smallest node.

    ``edges`` has columns (u, v) of one orderable type; loops and repeats are ignored. Large-star /
    small-star rounds end after O(log^2 n) rounds, also on long chains.
    """
    start = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars = cut(start)
    for _ in range(MOST_ROUNDS):
        n = stars.count()
        parts = max(LEAST_PARTS, n // EDGES_A_PART + 1)
        stars = stars.coalesce(parts)
        if not _open_nodes(stars, parts):
            break
        stars = cut(_star_round(stars, parts, n <= BROADCAST_EDGES))
    else:
        raise RuntimeError(f"no components after {MOST_ROUNDS} rounds")
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
