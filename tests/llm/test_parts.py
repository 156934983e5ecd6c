"""Parts of the text operators against plain versions of themselves."""

from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isovane.llm import bottomk, maxscore, packing, quality, sharding, simhash


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 1), (3, 1)])
def test_the_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    cells = spark.range(side**dims).select(*[F.expr(f"cast((id div {side**j}) % {side} as int)").alias(f"c{j}") for j in range(dims)])
    names = [f"c{j}" for j in range(dims)]
    rows = cells.withColumn("place", sharding.hilbert_index([F.col(c) for c in names], bits)).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(side**dims))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def test_anchors_bring_close_halves_together():
    masks = simhash.anchor_masks()
    rng = random.Random(5)

    def syndrome(half):
        return int(np.bitwise_xor.reduce([p for p in range(1, 32) if half >> (p - 1) & 1] or [0]))

    for _ in range(300):
        half = rng.getrandbits(32)
        other = half ^ (1 << rng.randrange(32))
        home = half ^ masks[syndrome(half)][0]
        assert home in {other ^ m for m in masks[syndrome(other)]}
        assert syndrome(home) == 0


def test_links_against_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 6))) for b in base for _ in range(4)]
    signed = sorted({(x - (1 << 64) if x >> 63 else x) for x in base + near})
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_sum_of_squares_places_every_piece(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset = packing.place(lengths, 64)
    for s in set(sequence.tolist()):
        mine = sorted(zip(offset[sequence == s].tolist(), lengths[sequence == s].tolist(), strict=True))
        at = 0
        for o, n in mine:
            assert o == at
            at += n
        assert at <= 64


def test_place_follows_the_rule():
    """Each choice is the one with the least sum of squares, by counting anew."""
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 33, 200))[::-1]
    sequence, offset = packing.place(lengths, 32)
    gaps: dict[int, int] = {}

    def squares(g):
        counts = np.bincount([x for x in g.values() if x], minlength=33)
        return int((counts**2).sum())

    for s, at, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        options = [squares(gaps | {i: g - s}) for i, g in gaps.items() if g >= s]
        assert (at in gaps) == bool(options)
        after = gaps | {at: gaps.get(at, 32) - s}
        assert o == 32 - gaps.get(at, 32)
        assert not options or squares(after) == min(options)
        gaps = after


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_rank_file_gives_the_ids_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path(packing.VOCABULARY)
    for body in (text, f"it's <|endoftext|>{text}  \n {text} 12"):
        assert packing.token_ids(body, path).tolist() == [*_tokenizer.encode(body, add_special_tokens=False).ids, 2]


def test_rank_file_is_the_same_vocabulary():
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    with open(public_tokenizers.path(packing.VOCABULARY), "rb") as f:
        ranks = [int(line.split()[1]) for line in f]
        f.seek(0)
        assert all(base64.b64decode(line.split()[0]) for line in f)
    assert sorted(vocabulary.values()) == sorted(ranks)


@pytest.mark.parametrize("dense", [True, False])
def test_maxscore_against_all_products(dense):
    rng = np.random.default_rng(11)
    n, dims = 400, 24
    matrix = rng.integers(-50, 60, (n, dims))
    if not dense:
        matrix[rng.random((n, dims)) < 0.8] = 0
    ids = rng.permutation(n)
    terms = [np.flatnonzero(v) for v in matrix]
    shard = maxscore.Shard.build(ids, terms, [v[t].astype(float) for v, t in zip(matrix, terms, strict=True)])
    for i in range(0, n, 13):
        query = {int(t): int(matrix[i, t]) for t in terms[i]}
        got_ids, got_scores, _ = maxscore.top_k(shard, query, int(ids[i]), 10)
        products = matrix @ matrix[i]
        want = sorted((-int(s), int(j)) for s, j in zip(products, ids, strict=True) if j != ids[i])[:10]
        assert [(-int(s), int(j)) for s, j in zip(got_scores, got_ids, strict=True)] == want


def test_maxscore_skips_rows_of_sparse_queries():
    """A rare heavy term makes the common light ones non-essential."""
    n = 5_000
    terms = [np.array([0, 1]) if i % 50 == 0 else np.array([0]) for i in range(n)]
    weights = [np.array([1.0 + i % 3, 100.0 + i % 7])[: len(t)] for i, t in enumerate(terms)]
    shard = maxscore.Shard.build(np.arange(n), terms, weights)
    ids, scores, scored = maxscore.top_k(shard, {0: 1, 1: 1}, None, 10)
    assert scored <= n // 50 and len(ids) == 10 and scores.min() > 100


def test_maxscore_with_numbers_beyond_64_bits():
    shard = maxscore.Shard.build(np.arange(3), [np.array([0])] * 3, [np.array([w]) for w in (1e30, -1e30, 5.0)])
    ids, scores, _ = maxscore.top_k(shard, {0: 10**20}, 2, 2)
    assert ids.tolist() == [0, 1] and scores[0] == int(1e30) * 10**20


def test_isotonic_levels_do_not_fall():
    knots, levels = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert levels == sorted(levels) and len(knots) == len(levels)
    assert levels[0] == 0 and levels[-1] == 1 and pytest.approx(1 / 3) == levels[1]


def test_sketches_merge_into_the_sketch_of_the_whole(spark):
    rows = [(i % 2, h * 7919 % 100_003) for i in range(4) for h in range(i * 50, i * 50 + 120)]
    df = spark.createDataFrame(rows, "part int, h long").groupBy("part").agg(F.slice(F.sort_array(F.collect_set("h")), 1, 32).alias("sketch"))
    merged = bottomk.merge(df.withColumn("all", F.lit(1)), "all", k=32).first()["sketch"]
    assert merged == sorted({h for _, h in rows})[:32]
