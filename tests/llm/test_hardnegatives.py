"""Hard negatives against all scores of all rows, on few and many shards, with ties, repeated ids and odd vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isovane.llm import hardnegatives as hard
from isovane.llm import queries
from tests.compare import differing, duck, rows_of

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
TOP = (1 << 63) - 1


def plain(rows: list[tuple]) -> list[tuple]:
    """All rows against every anchor; whole numbers of any size."""
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, q, own) in enumerate(kept):
        if i % 50:
            continue
        score = [max(-TOP - 1, min(TOP, sum(x * y for x, y in zip(q, v, strict=False)))) for _, v, _ in kept]
        order = sorted(range(len(kept)), key=lambda r: (-score[r], kept[r][0], r))
        for p in [r for r in order if r != a and kept[r][2] == own][:5]:
            inside = [r for r in order if kept[r][2] != own and 50 * score[p] <= 100 * score[r] <= 95 * score[p]]
            out += [(i, kept[p][0], k + 1, kept[r][0], score[p], score[r]) for k, r in enumerate(inside[:3])]
    return out


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS row", "1 AS shard", "2 AS anchor")


def some(n: int, dim: int, seed: int, levels: int = 4) -> list[tuple]:
    """Vectors of few levels, so that many scores are equal."""
    rng = random.Random(seed)
    return [(rng.randrange(n), [rng.randrange(-levels, levels + 1) / 8 for _ in range(dim)], rng.randrange(4)) for _ in range(n)]


@pytest.mark.parametrize("shard_rows,block", [(8_192, 2_048), (60, 2)])
def test_all_scores(spark, shard_rows, block):
    rows = some(700, 6, 3) + [(50, [0.5] * 6, 1), (50, [0.5] * 6, 1), (50, [-0.5] * 6, 2), (100, [0.0] * 6, 0)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard.mine(hard.usable(frame(spark, rows), label), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_anchors=block)
    assert got.columns == NAMES and [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = plain(rows)
    assert len(want) > 100 and rows_of(NAMES, got.collect()) == rows_of(NAMES, want)


def test_odd_rows(spark):
    """Nulls, empty and short vectors, numbers that are not finite, scores beyond 64 bits; none of them crashes."""
    big = float(1 << 40)
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 0.9], 2), (3, [0.8], 3), (4, [], 3), (5, None, 1), (6, [1.0, None], 1), (8, [1.0, math.nan], 1),
        (9, [math.inf, 1.0], 2), (10, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (50, [], 3), (100, [big, big], 5), (101, [big, 0.0], 5), (102, [big / 2, big / 8], 6),
        (103, [-0.001, 0.9], 6), (150, [1e200, 1.0], 7), (151, [1e200, 1.0], 7), (152, [6e199, 0.5], 8), (200, [0.7, 0.7], 1), (250, [-1.0, -1.0], 1),
    ]
    got = hard.digest(frame(spark, rows))
    assert rows_of(NAMES, got.collect()) == rows_of(NAMES, plain(rows))


def test_empty_tables(spark):
    assert hard.digest(frame(spark, [])).collect() == []
    assert hard.digest(frame(spark, [(50, None, 1), (1, [1.0], None)])).collect() == []
    assert hard.digest(frame(spark, [(51, [1.0], 1)])).collect() == []


def test_scores_lie_in_their_brackets_and_rows_are_passed_over():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (20, 16))
    x = np.repeat(centres, 200, 0) + rng.normal(0, 8, (4_000, 16))
    x = np.floor(1_600 * x / np.linalg.norm(x, axis=1)[:, None])
    largest = float((x**2).sum(1).max())
    pivots = hard.choose_pivots(x[::16])
    table = hard.distances(x, largest, pivots)
    shard = hard.Shard(pd.DataFrame({"row": range(4_000), "vec_id": range(4_000), "label": np.arange(4_000) % 2, "vector": [v.tobytes() for v in x], "dist": [d.tobytes() for d in table]}))
    for q in x[::500]:
        far = hard.anchor_distances(q, largest, pivots)
        least, most = hard.brackets(table, q, far, largest)
        exact = x @ q
        assert (least <= exact).all() and (exact <= most).all()
        shard.scored = 0
        best = shard.best(q, far, largest, -1, 5)
        assert [s for _, _, s in best] == sorted(exact.astype(int).tolist())[:-6:-1] and shard.scored < 2_000
        band = (int(exact.max() * 0.5), int(exact.max() * 0.95))
        found = shard.in_bands(q, far, largest, 1, [band, (5, 4)], 3)
        want = sorted((s for s in exact[::2].astype(int).tolist() if band[0] <= s <= band[1]), reverse=True)[:3]
        assert [s for _, _, s in found[0]] == want and found[1] == []


def test_one_label_and_one_vector_hold_a_third(spark):
    rows = [(i, [0.5, 0.25, 0.125] if i % 3 == 0 else [((i * 7) % 11) / 11, ((i * 5) % 13) / 13, (i % 17) / 17], 1 if i % 3 == 0 else i % 10) for i in range(600)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard.mine(hard.usable(frame(spark, rows), label), F.col("vec_id") % 50 == 0, shard_rows=100, block_anchors=5)
    assert rows_of(NAMES, got.collect()) == rows_of(NAMES, plain(rows))


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differing(spark, sf, queries.op12_hard_negatives, hard.ORACLE) == ""
    rows = duck(sf).execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert rows_of(NAMES, queries.op12_hard_negatives(spark, sf).collect()) == rows_of(NAMES, plain(rows))
