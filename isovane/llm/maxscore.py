"""Exact top-k search by MaxScore over sharded postings.

Rows are sparse vectors: ids with terms and weights. Candidates are dealt into shards of bounded size, queries
into blocks; each (shard, block) is one group that indexes its shard once and runs its queries. A term's
score bound is the largest contribution it can make in the shard. Terms in order of bound are split
at the current threshold: rows found in none of the essential terms' postings stay below it together, so only
essential postings are traversed; the other terms are probed, largest bound first, for rows that can
still reach the threshold. The k best of all shards are merged.

Weights may be negative: a contribution below zero never adds to a bound, so postings of a term are read
on the side that raises the score, and the other side only lowers rows already found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isovane.plans.lineage import cut

TOP = 10
SHARD_ROWS = 8_192
BLOCK_QUERIES = 1_024
QUERY_EVERY = 100
SCALE = 1024
#: Sums of products below this are exact in 64-bit integers; others are computed with Python's integers.
EXACT = 1 << 62
LONGEST = (1 << 63) - 1


@dataclass
class Shard:
    """Postings of one shard: for each term the rows that have it, in row order, and their weights."""

    ids: np.ndarray
    keys: np.ndarray
    rows: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    high: dict[int, int]
    low: dict[int, int]
    exact: bool

    @classmethod
    def build(cls, ids: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray], keys: np.ndarray | None = None) -> Shard:
        """Rows in order of id, so that of equal scores the first row wins. ``keys`` tell rows of one id apart; without them ids do."""
        order = np.argsort(ids, kind="stable")
        keys = ids if keys is None else keys
        sizes = np.array([len(terms[i]) for i in order], np.int64)
        row = np.repeat(np.arange(len(order)), sizes)
        term = np.concatenate([terms[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        value = np.concatenate([weights[i] for i in order]) if len(order) else np.zeros(0)
        exact = not len(value) or float(np.abs(value).max()) < 2**40
        value = value.astype(np.int64) if exact else np.array([int(v) for v in value], object)
        by_term = np.argsort(term, kind="stable")
        term, row, value = term[by_term], row[by_term], value[by_term]
        found, starts = np.unique(term, return_index=True)
        ends = [*starts[1:].tolist(), len(term)]
        rows, kept, high, low = {}, {}, {}, {}
        for t, a, b in zip(found.tolist(), starts.tolist(), ends, strict=True):
            rows[t], kept[t], high[t], low[t] = row[a:b], value[a:b], int(value[a:b].max()), int(value[a:b].min())
        return cls(ids[order], keys[order], rows, kept, high, low, exact)

    def weight_of(self, term: int, candidates: np.ndarray) -> np.ndarray:
        """The weights of ``candidates`` (row numbers, rising) in a term; 0 where they don't have it."""
        rows, values = self.rows[term], self.weights[term]
        if len(rows) == len(self.ids):
            return values[candidates]
        at = np.minimum(np.searchsorted(rows, candidates), len(rows) - 1)
        return np.where(rows[at] == candidates, values[at], 0)


def top_k(shard: Shard, query: dict[int, int], own: int | None, k: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the ``k`` best rows whose key is not ``own``, and how many rows were scored in full.

    Equal scores go to the smaller id. Rows without any term of the query score 0 and take part.
    """
    small = shard.exact and sum(abs(w) * max(abs(shard.high[t]), abs(shard.low[t])) for t, w in query.items() if t in shard.rows) < EXACT
    kind = np.int64 if small else object
    terms = [(max(w * shard.high[t], w * shard.low[t], 0), t, w) for t, w in query.items() if t in shard.rows and w]
    terms.sort()
    bounds = [b for b, _, _ in terms]
    below = [0]
    for b in bounds:
        below.append(below[-1] + b)
    n = len(shard.ids)
    total, found = np.zeros(n, kind), np.zeros(n, bool)
    barred = shard.keys == own if own is not None else np.zeros(n, bool)
    threshold, at = None, len(terms)
    # Traverse postings from the largest bound down, until rows not found yet can't reach the threshold.
    while at > 0 and (threshold is None or below[at] >= threshold):
        at -= 1
        _, t, w = terms[at]
        rows, values = shard.rows[t], shard.weights[t]
        gains = values > 0 if w > 0 else values < 0
        total[rows] += values * w
        found[rows[gains]] = True
        done = len(terms) - at
        if done % 8 == 0 or done & (done - 1) == 0 or at == 0:
            threshold = _raised(shard, terms[:at], total, found, barred, k, threshold)
    unseen = at == 0 and (threshold is None or threshold <= 0)
    alive = np.flatnonzero((found | unseen) & ~barred)
    scores = total[alive]
    # Probe the others for what can still reach the threshold.
    while at > 0 and len(alive):
        if threshold is not None:
            stays = scores + below[at] >= threshold
            alive, scores = alive[stays], scores[stays]
        at -= 1
        _, t, w = terms[at]
        scores = scores + shard.weight_of(t, alive) * w
    best = np.lexsort((alive, -scores))[:k] if small else np.array(sorted(range(len(alive)), key=lambda i: (-scores[i], i))[:k], int)
    return shard.ids[alive[best]], scores[best], len(alive)


def _raised(shard: Shard, rest: list[tuple[int, int, int]], total: np.ndarray, found: np.ndarray, barred: np.ndarray, k: int, threshold):
    """The threshold after scoring in full the ``k`` rows that lead so far: the least of their scores."""
    some = np.flatnonzero(found & ~barred)
    if len(some) < k:
        return threshold
    partial = total[some]
    lead = np.argpartition(partial, len(partial) - k)[-k:] if partial.dtype != object else np.argsort(partial)[-k:]
    lead = np.sort(some[lead])
    scores = total[lead]
    for _, t, w in rest:
        scores = scores + shard.weight_of(t, lead) * w
    least = int(scores.min())
    return least if threshold is None else max(threshold, least)


def search(candidates: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``candidates`` with the largest inner products.

    Both have (row, vec_id, terms array<int>, weights array<double>), weights whole numbers, terms of a row distinct; ``row`` is
    a number that no two rows of a side share. Rows, not ids, are queries and candidates: of rows with one vec_id each asks and
    each is found. The row that asks is no candidate, every other is; equal scores go to the smaller vec_id. Fewer candidates give
    fewer rows. Scores outside 64 bits end at its limits. Null ids take no part.

    Every candidate goes to one shard, copied once for each block of queries; every query to one block, copied
    once for each shard. Both are of bounded size, and no task gets more than one shard and one block at a time.
    """
    rows = cut(candidates.where(F.col("vec_id").isNotNull()).select("row", "vec_id", "terms", "weights"))
    asked = cut(queries.where(F.col("vec_id").isNotNull()).select("row", "vec_id", "terms", "weights"))
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = rows.select("*", dealt(shards).alias("shard"), spread(blocks).alias("block"))
    right = asked.select("*", spread(shards).alias("shard"), dealt(blocks).alias("block"))

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        index = Shard.build(mine["vec_id"].to_numpy(np.int64), list(mine["terms"]), list(mine["weights"]), mine["row"].to_numpy(np.int64))
        out = []
        for row, query_id, terms, weights in zip(theirs["row"].tolist(), theirs["vec_id"].tolist(), theirs["terms"], theirs["weights"], strict=True):
            ids, scores, _ = top_k(index, {int(t): int(w) for t, w in zip(terms, weights, strict=True)}, row, k)
            out += [(row, query_id, i, max(-LONGEST - 1, min(LONGEST, int(s)))) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    grid = ["shard", "block"]
    parts = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    merged = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(y: Column) -> Column:
    """floor as a double; beyond 2^52 every double is whole."""
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component, x as double; null for a vector that is null or has a null or non-finite one."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: _floor(F.lit(float(scale)) * x.cast("double"))))


def embedding_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, terms, weights) of usable vectors: a term for each dimension with a component other than 0.

    The rows are stored, so that ``row``, which tells rows of one vec_id apart, is the same whenever they are read.
    """
    scaled = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("v")).where(F.col("v").isNotNull())
    kept = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("t"), x.alias("w"))), lambda c: c.w != 0)
    named = scaled.select("vec_id", kept.alias("c")).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("c.t").alias("terms"), F.col("c.w").alias("weights"))
    return cut(named)


def digest(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """The ``k`` best rows for each query: rows whose vec_id ``every`` divides."""
    rows = embedding_rows(embeddings)
    return search(rows, rows.where(F.col("vec_id") % every == 0), k)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT r, vec_id, unnest(v) AS w, unnest(range(len(v))) AS t FROM v),
s AS (
  SELECT q.r AS asked, q.vec_id AS query_id, c.r, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM e q JOIN e c ON q.t = c.t AND q.r <> c.r WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id, r) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
