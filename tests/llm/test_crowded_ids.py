"""Neighbours in order of ids where one id, or none, is that of most rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isovane.llm import bottomk


def edited_by_hand(rows: list[tuple]) -> Counter:
    """(doc_id, text, edited) by one sort of (id downward, hash of text); rows: (doc_id, text, hash)."""
    low = -(1 << 63)
    rows = sorted(((d, t or "", h) for d, t, h in rows), key=lambda r: (-(low if r[0] is None else r[0]), r[2]))
    out = Counter()
    for (d, text, _), (_, after, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 3
        out[d, text, text[: len(text) - n] + after[:n]] += 1
    return out


def rows_of(kind: str) -> list[tuple]:
    rng = random.Random(kind)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(rng.randrange(0, 9)))
    single = [(i - 40, text()) for i in range(80)]
    if kind == "null":
        return single + [(None, text()) for _ in range(120)] + [(None, None)] * 3
    if kind == "one":
        return single + [(7, text()) for _ in range(120)] + [(8, text()) for _ in range(50)]
    if kind == "copies":
        return single + [(None, "all the same text here")] * 90 + [(7, "again the same text")] * 60 + [(7, text()) for _ in range(20)]
    return [(None, text()) for _ in range(100)] if kind == "only" else [(5, "one text, many rows")] * 70


@pytest.mark.parametrize("kind", ["null", "one", "copies", "only", "same"])
@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_neighbours_against_one_sort(spark, monkeypatch, kind, broadcast):
    monkeypatch.setattr(bottomk, "DEPTH", 6)
    monkeypatch.setattr(bottomk, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(rows_of(kind), "doc_id long, text string")
    hashed = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = bottomk.edit_pairs(docs).select("doc_id", "text", "edited", "sketch", "edited_sketch")
    assert Counter((r.doc_id, r.text, r.edited) for r in got.collect()) == edited_by_hand(hashed)


def test_a_crowd_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "DEPTH", 50)
    docs = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    bucket, crowded = bottomk._buckets(docs, key, F.xxhash64("text"), 16)
    sizes = docs.groupBy(bucket.alias("b"), crowded.alias("c")).count().collect()
    assert sum(r["count"] for r in sizes if r.c) == 3000 and max(r["count"] for r in sizes) < 150
    assert not {r.b for r in sizes if r.c} & {r.b for r in sizes if not r.c}
