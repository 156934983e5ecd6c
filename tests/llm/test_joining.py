"""Groups of fingerprints in crowds: balls around one, with and without it, and families that share a half."""

from __future__ import annotations

import itertools
import random

import pytest

from isovane.llm import simhash
from isovane.plans.fixpoint import connected_components


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(centre: int, most: int, whole: bool = True) -> list[int]:
    return [centre ^ sum(1 << i for i in c) for n in range(0 if whole else most, most + 1) for c in itertools.combinations(range(64), n)]


def groups(fps: list[int], threshold: int = 3) -> dict[int, int]:
    """Smallest fingerprint that each reaches, by comparing all pairs."""
    fps, found = sorted(fps), {}
    rest = set(fps)
    for first in fps:
        if first not in rest:
            continue
        rest.discard(first)
        front, found[first] = [first], first
        while front:
            at = front.pop()
            near = [x for x in rest if ((x ^ at) & (2**64 - 1)).bit_count() <= threshold]
            rest.difference_update(near)
            front.extend(near)
            found |= dict.fromkeys(near, first)
    return found


def crowd(kind: str) -> list[int]:
    rng = random.Random(kind)
    centre = rng.getrandbits(64)
    if kind == "ball":
        return rng.sample(ball(centre, 2), 900) + rng.sample(ball(centre, 3), 900)
    if kind == "sphere":
        return rng.sample(ball(centre, 2, whole=False), 1200)
    if kind == "half":
        low = rng.getrandbits(32)
        base = [low | rng.getrandbits(32) << 32 for _ in range(700)]
        return base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5))) for b in base[:500]]
    return [centre ^ (i << 20) for i in range(1500)]


@pytest.mark.parametrize("kind", ["ball", "sphere", "half", "count"])
@pytest.mark.parametrize("threshold", [3, 1])
def test_crowds_keep_their_groups(spark, kind, threshold):
    fps = sorted({signed(x) for x in crowd(kind)})
    found = simhash.joining_links(spark.createDataFrame([(x,) for x in fps], "fp long"), threshold)
    rows = found.collect()
    assert all(r.u < r.v and ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= threshold for r in rows)
    got = {x: x for x in fps} | {r.node: r.component for r in connected_components(found).collect()}
    assert got == groups(fps, threshold)


def test_a_small_crowd_among_many_is_not_split(spark, monkeypatch):
    """Splitting takes a dozen shuffles: it is for crowds whose comparisons outnumber the rows of the covering."""
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    crowd_ = [centre ^ sum(1 << i for i in rng.sample(range(32, 64), 3)) for _ in range(90)]
    fps = sorted({signed(x) for x in crowd_ + [rng.getrandbits(64) for _ in range(1900)]})
    monkeypatch.setattr(simhash, "_centres", lambda home: pytest.fail("split"))
    got = {x: x for x in fps} | {r.node: r.component for r in simhash.linked_groups(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == groups(fps)


@pytest.mark.parametrize("kind", ["ball", "half"])
def test_groups_of_crowds_by_their_first_groups(spark, kind):
    fps = sorted({signed(x) for x in crowd(kind)})
    got = {x: x for x in fps} | {r.node: r.component for r in simhash.linked_groups(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == groups(fps)
