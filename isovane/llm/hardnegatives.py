"""Hard-negative mining with a pivot table.

Vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm; anchors are stretched to that norm, by c, and
get a 0 there. Then |x' - q'|^2 = 2 M - 2 c x.q, so the larger inner product is the smaller Euclidean distance, and the
triangle inequality holds. Every row stores its distances to a few pivots; with the anchor's own, |d(q, p) - d(x, p)| and d(q, p) + d(x, p) bracket
d(q, x), and so the score. Rows whose bracket can't matter are passed over, all others are checked exactly in
whole numbers.

Rows are dealt into shards of bounded size, anchors into blocks; each (shard, block) is one group of bounded size, split by
label once more where positives are sought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from isovane.llm.maxscore import LONGEST, whole_numbers
from isovane.plans.lineage import cut

ANCHOR_EVERY = 50
SHIFTED_EVERY = 7
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Percent of the positive's score that a negative's score must reach and may not exceed.
BAND = (50, 95)
PIVOTS = 12
#: Pivots are chosen among this many rows: a bounded sample, those with the smallest hashes.
PIVOT_SAMPLE = 256
SHARD_ROWS = 8_192
BLOCK_ANCHORS = 2_048
#: Rows scored first; the worst of the best of them is the threshold for the rest.
SEEDS = 64
#: Relative error that distances from rounded arithmetic may have.
SLACK = 1e-9
#: Whole numbers below this are exact in doubles, sums of their products too.
WHOLE = 1 << 53


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` rows of ``sample`` that lie far apart: each next one is farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    with np.errstate(all="ignore"):
        gap = ((sample - sample[0]) ** 2).sum(1)
        while len(chosen) < min(n, len(sample)) and np.nanmax(gap) > 0:
            chosen.append(int(np.nanargmax(gap)))
            gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, largest: float, pivots: np.ndarray) -> np.ndarray:
    """Distances of augmented rows to augmented pivots; not finite where squares overflow."""
    with np.errstate(all="ignore"):
        rest = lambda v: np.sqrt(np.maximum(largest - (v**2).sum(1), 0))
        own, theirs = rest(x), rest(pivots)
        return np.stack([np.sqrt(((x - p) ** 2).sum(1) + (own - e) ** 2) for p, e in zip(pivots, theirs, strict=True)], 1) if len(pivots) else np.zeros((len(x), 0))


def stretch(q: np.ndarray, largest: float) -> float:
    """What an anchor is multiplied by so that its norm is the largest one; its order of scores stays."""
    with np.errstate(all="ignore"):
        norm = float(np.sqrt((q**2).sum()))
        c = float(np.sqrt(largest)) / norm if norm else 1.0
    return c if np.isfinite(c) and c > 0 else 1.0


def anchor_distances(q: np.ndarray, largest: float, pivots: np.ndarray) -> np.ndarray:
    """Distances of one stretched anchor, whose added component is 0, to the augmented pivots."""
    with np.errstate(all="ignore"):
        return np.sqrt(((pivots - stretch(q, largest) * q) ** 2).sum(1) + np.maximum(largest - (pivots**2).sum(1), 0))


def brackets(table: np.ndarray, q: np.ndarray, far: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): between these the score of each row of a pivot table lies; without bounds where numbers overflow."""
    if not table.shape[1]:
        return np.full(len(table), -np.inf), np.full(len(table), np.inf)
    with np.errstate(all="ignore"):
        near, wide = np.abs(table - far).max(1), (table + far).min(1)
        c = stretch(q, largest)
        total = largest + float(((c * q) ** 2).sum())
        slack = SLACK * (total + wide**2) + 1
        least, most = ((total - wide**2) / 2 - slack) / c - 1, ((total - near**2) / 2 + slack) / c + 1
    return np.where(np.isfinite(least), least, -np.inf), np.where(np.isfinite(most), most, np.inf)


class Shard:
    """The rows of one shard with their distances to the pivots, in order of vec_id, so that of equal scores the first wins."""

    def __init__(self, frame: pd.DataFrame) -> None:
        frame = frame.sort_values(["vec_id", "row"], kind="stable")
        self.rows, self.ids, self.labels = (frame[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))
        self.x, self.table = _matrix(frame["vector"]), _matrix(frame["dist"])
        self.high = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.scored = 0

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows with an anchor, ended at the limits of 64 bits."""
        self.scored += len(at)
        w = min(self.x.shape[1], len(q))
        x, q = self.x[at, :w], q[:w]
        if self.high * float(np.abs(q).max() if w else 0) * w < WHOLE:
            return (x @ q).astype(np.int64)
        b = [int(v) for v in q]
        exact = (sum(int(v) * u for v, u in zip(r, b, strict=True)) for r in x)
        return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in exact], np.int64)

    def best(self, q: np.ndarray, far: np.ndarray, largest: float, own: int, k: int) -> list[tuple[int, int, int]]:
        """(row, vec_id, score) of the ``k`` best rows but the anchor's own."""
        _, most = brackets(self.table, q, far, largest)
        alive = np.flatnonzero(self.rows != own)
        if len(alive) > SEEDS >= k:
            lead = alive[np.argpartition(-most[alive], SEEDS)[:SEEDS]]
            threshold = np.sort(self.scores(lead, q))[-k]
            alive = alive[_reaches(most[alive], threshold)]
        return self._first(alive, self.scores(alive, q), k)

    def in_bands(self, q: np.ndarray, far: np.ndarray, largest: float, own: int, bands: list[tuple[int, int]], k: int) -> list[list[tuple[int, int, int]]]:
        """For every band (low, high) the ``k`` best rows (row, vec_id, score) of other labels with a score in it."""
        least, most = brackets(self.table, q, far, largest)
        alive, known = np.flatnonzero(self.labels != own), np.zeros(0, np.int64)
        if len(alive) > SEEDS >= k:
            known = self.scores(alive[np.argpartition(-most[alive], SEEDS)[:SEEDS]], q)
        wanted = np.zeros(len(alive), bool)
        for low, high in bands:
            if low > high:
                continue
            inside = np.sort(known[(known >= low) & (known <= high)])
            threshold = max(low, int(inside[-k])) if len(inside) >= k else low
            wanted |= _reaches(most[alive], threshold) & _reaches(-least[alive], -high)
        alive = alive[wanted]
        scores = self.scores(alive, q)
        inside = [(scores >= low) & (scores <= high) for low, high in bands]
        return [self._first(alive[i], scores[i], k) for i in inside]

    def _first(self, at: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        order = np.lexsort((at, -np.maximum(scores, -LONGEST)))[:k]
        return [(int(self.rows[at[i]]), int(self.ids[at[i]]), int(scores[i])) for i in order]


def _reaches(bound: np.ndarray, whole: int) -> np.ndarray:
    """bound >= whole, with room for what a double can't hold of a whole number."""
    return bound >= float(whole) - abs(float(whole)) * 1e-15 - 1


def _matrix(blobs: pd.Series) -> np.ndarray:
    """Rows of doubles, stored as bytes; shorter ones are padded by zeros."""
    sizes = {len(b) for b in blobs}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    out = np.zeros((len(blobs), max(sizes, default=0) // 8))
    for i, b in enumerate(blobs):
        out[i, : len(b) // 8] = np.frombuffer(b, np.float64)
    return out


def usable(embeddings: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, weights) of the rows that take part; ``row`` tells rows of one vec_id apart.

    Null ids, labels or vectors, and vectors with a null or non-finite component, take no part.
    """
    known = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole_numbers(F.col("embedding"), scale).alias("weights"))
    kept = known.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("weights").isNotNull())
    return cut(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "weights"))


def _stored(rows: DataFrame, largest: float, pivots: np.ndarray) -> DataFrame:
    """The pivot table: each row with its vector and its distances, both as bytes of doubles."""
    schema = T.StructType([*rows.drop("weights").schema.fields, T.StructField("vector", T.BinaryType()), T.StructField("dist", T.BinaryType())])
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(batch.num_columns - 1)]
            dist = (distances(np.pad(v, (0, width - len(v)))[None], largest, pivots) for v in vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([d.tobytes() for d in dist], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
    shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` of usable().

    ``anchors`` says which rows are anchors. An anchor's positives are its ``positives`` best other rows of its label; for each
    of them come the best ``negatives`` rows of other labels whose score lies between the percentages of ``band`` of the
    positive's. Scores are inner products of whole numbers; ties go to the smaller vec_id. Rows, not ids, are anchors
    and candidates: of rows that share a vec_id each counts. Vectors of different lengths meet as if padded by
    zeros. Scores outside 64 bits end at its limits. The band of a negative score is empty.

    Every row goes to one shard, copied once for each block of anchors, every anchor to one block, copied once for each
    shard. Each shard gives its best few; windows over (anchor) and (anchor, positive) keep the best of all shards, and Spark
    limits them before it shuffles.
    """
    norm = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x * x)
    total, width, largest = rows.agg(F.count("*"), F.max(F.size("weights")), F.max(norm)).first()
    sample = [r.weights for r in rows.orderBy(F.xxhash64("weights"), "vec_id").select("weights").limit(PIVOT_SAMPLE).collect()]
    padded = np.zeros((len(sample), width or 0))
    for i, v in enumerate(sample):
        padded[i, : len(v)] = v
    largest, pivots = largest or 0.0, choose_pivots(padded)
    shards = max(1, -(-total // shard_rows))
    table = cut(_stored(rows, largest, pivots).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    asked = cut(table.where(anchors).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), "vector"))
    blocks = max(1, -(-asked.count() // block_anchors))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
    left = table.select("row", "vec_id", "label", "vector", "dist", "shard", spread(blocks).alias("block"))

    def reach(theirs: pd.DataFrame) -> Iterator[tuple]:
        """(anchor, its label, its vector, its distances to the pivots)."""
        for anchor, own, blob in zip(theirs["anchor"].tolist(), theirs["own"].tolist(), theirs["vector"], strict=True):
            q = np.frombuffer(blob, np.float64)
            yield anchor, own, q, anchor_distances(np.pad(q, (0, pivots.shape[1] - len(q))), largest, pivots)

    def positive(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(ours) and len(theirs):
            shard = Shard(ours)
            for anchor, _, q, far in reach(theirs):
                out += [(anchor, *r) for r in shard.best(q, far, largest, anchor, positives)]
        return pd.DataFrame(out, columns=["anchor", "row", "vec_id", "score"]).astype("int64")

    # anchors meet the rows of their label only
    near = (
        left.groupBy("label", "shard", "block")
        .cogroup(asked.select("*", F.col("own").alias("label"), spread(shards).alias("shard")).groupBy("label", "shard", "block"))
        .applyInPandas(positive, "anchor long, row long, vec_id long, score long")
    )
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    best = cut(near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))
    scores = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # ``positives`` at most
    ready = cut(asked.join(scores, "anchor").select("anchor", "own", "block", "vector", F.col("p.place").alias("places"), F.col("p.score").alias("scores")))

    def negative(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(ours) and len(theirs):
            shard = Shard(ours)
            for (anchor, own, q, far), places, known in zip(reach(theirs), theirs["places"], theirs["scores"], strict=True):
                bands = [(-(-band[0] * s // 100), band[1] * s // 100) for s in (int(s) for s in known)]
                for place, found in zip(places, shard.in_bands(q, far, largest, own, bands, negatives), strict=True):
                    out += [(anchor, int(place), *r) for r in found]
        return pd.DataFrame(out, columns=["anchor", "place", "row", "vec_id", "score"]).astype("int64")

    away = (
        left.groupBy("shard", "block")
        .cogroup(ready.select("*", spread(shards).alias("shard")).groupBy("shard", "block"))
        .applyInPandas(negative, "anchor long, place long, row long, vec_id long, score long")
    )
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    hard = away.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.join(asked.select("anchor", "anchor_id"), "anchor").select("anchor", F.col("place").cast("long").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The query's fixed case: labels of every seventh id move on by one, every fiftieth id is an anchor."""
    label = F.when(F.col("vec_id") % SHIFTED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(usable(embeddings, label), F.col("vec_id") % ANCHOR_EVERY == 0)


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT r, vec_id, label, unnest(v) AS w, unnest(range(len(v))) AS t FROM v),
s AS (
  SELECT q.r AS a, q.vec_id AS anchor_id, c.r AS c, c.vec_id, q.label = c.label AS same, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM e q JOIN e c ON q.t = c.t AND q.r <> c.r WHERE q.vec_id % 50 = 0 GROUP BY ALL),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
