"""Orientation and flips in batches of levels against plain wavefronts over one array of samples."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from isovane.operators import normals, waves
from isovane.operators.stencil import box

COLUMNS = "x int, y int, z int, kind string, nx double, ny double, nz double"
BOX = box(1)


def key(p):
    return ((p[0] + (1 << 20)) << 42) | ((p[1] + (1 << 20)) << 21) | (p[2] + (1 << 20))


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def continues(step, a, b, most):
    one, two, s = math.sqrt(dot(a, a)), math.sqrt(dot(b, b)), math.sqrt(dot(step, step))
    return one > 1e-10 and two > 1e-10 and max(abs(dot(step, a)) / one / s, abs(dot(step, b)) / two / s) <= most


def links(core, spacing, most, least):
    """(v, [(u, offset, alignment)]) of the pairs that may vote."""
    out = {}
    for v, n in core.items():
        for o in BOX:
            u = (v[0] - o[0], v[1] - o[1], v[2] - o[2])
            if u in core and continues([a * s for a, s in zip(o, spacing, strict=True)], core[u], n, most) and abs(dot(core[u], n)) >= least:
                out.setdefault(v, []).append((u, o, dot(core[u], n)))
    return out


def plain_orient(core, seed, direction, spacing, least=0.15, most=0.75):
    """sign, depth and parent of each sample, one level after another over all samples."""
    near = links(core, spacing, most, least)
    done, level = {seed: (1 if dot(core[seed], direction) >= 0 else -1, 0, None, (0, 0, 0))}, 0
    while True:
        fresh = {}
        for v, each in near.items():
            if v in done or not any(u in done and done[u][1] == level for u, _, _ in each):
                continue
            voters = [(u, o, a) for u, o, a in each if u in done]
            w = [a * a / dot(o, o) for _, o, a in voters]
            vote = sum(x * a * done[u][0] for x, (u, _, a) in zip(w, voters, strict=True))
            if len(voters) < (1 if level == 0 else 2) or abs(vote) < least * sum(w):
                continue

            def order(c):
                u, o, a = c
                e = done[u][3]
                along, size = dot(e, o), dot(e, e)
                return dot(o, o), along < 0, dot(o, o) - along * along / size if size else 0.0, -along, -abs(a), key(u)

            u, o, _ = min(voters, key=order)
            fresh[v] = (-1 if vote < 0 else 1, level + 1, key(u), o)
        if not fresh:
            break
        done |= fresh
        level += 1
    sign = {v: s[0] for v, s in done.items()}
    for _ in range(2):
        new = {}
        for v in sign:
            each = [(u, a) for u, _, a in near.get(v, []) if u in sign]
            vote, total = sum(a**3 * sign[u] for u, a in each), sum(a * a for _, a in each)
            new[v] = (-1 if vote < 0 else 1) if total > 1e-20 and abs(vote) >= least * total and done[v][1] > 0 else sign[v]
        sign = new
    return {v: (sign[v], *done[v][1:3]) for v in done}


def plain_flip(core, start, spacing, cap=250_000, most_mm=0.0, least=0.15, most=0.75):
    done, stops, level = {start: (None, 0)}, {}, 0
    while True:
        if len(done) >= cap:
            return done, "capped"
        fresh = {}
        for u in sorted(p for p, s in done.items() if s[1] == level):
            for o in BOX:
                v = (u[0] + o[0], u[1] + o[1], u[2] + o[2])
                if v not in core or v in done:
                    continue
                a, n = dot(core[u], core[v]), core[v]
                tests = [dot(n, n) <= 1e-20, not continues([c * s for c, s in zip(o, spacing, strict=True)], core[u], n, most), abs(a) < least,
                         most_mm > 0 and sum(((c - d) * s * 1000) ** 2 for c, d, s in zip(v, start, spacing, strict=True)) > most_mm**2, a <= -least]
                if any(tests):
                    stops[v] = min(stops.get(v, 9), tests.index(True))
                else:
                    fresh.setdefault(v, (key(u), level + 1))
        if not fresh:
            return done, stops
        done |= fresh
        level += 1


def wavy(n, m, seed=1, turned=0.4):
    """A bent sheet with holes, random signs and a few axes of no length."""
    rng, out = random.Random(seed), {}
    for i in range(n):
        for j in range(m):
            if rng.random() < 0.03:
                continue
            z = round(1.4 * math.sin(i / 9))
            nx, ny = -0.15 * math.cos(i / 9) + rng.uniform(-0.2, 0.2), rng.uniform(-0.2, 0.2)
            size = math.sqrt(nx * nx + ny * ny + 1) * (-1 if rng.random() < turned else 1)
            out[i - 5, j - 7, z] = (0.0, 0.0, 0.0) if rng.random() < 0.02 else (nx / size, ny / size, 1 / size)
    return out


def frame(spark, core):
    return spark.createDataFrame([(*p, "core", *n) for p, n in core.items()], COLUMNS)


def found(oriented, core):
    out = {}
    for r in oriented.where("kind = 'core' AND oriented").collect():
        out[r.x, r.y, r.z] = (1 if dot((r.nx, r.ny, r.nz), core[r.x, r.y, r.z]) > 0 else -1, r.depth, r.parent)
    return out


@pytest.mark.parametrize("size,levels,side", [((40, 40), 16, 32), ((30, 12), 3, 4), ((12, 7), 2, 5)])
def test_orientation_is_that_of_a_plain_wavefront(spark, monkeypatch, size, levels, side):
    monkeypatch.setattr(waves.spread, "__defaults__", (None, levels, side))
    monkeypatch.setattr(waves.revoted, "__defaults__", (2, side))
    core, spacing = wavy(*size), (1.0, 1.1, 0.9)
    seed = min(p for p, n in core.items() if n != (0.0, 0.0, 0.0))
    want = plain_orient({p: n for p, n in core.items() if n != (0.0, 0.0, 0.0)}, seed, (0, 0, 1), spacing)
    assert len(want) > 0.6 * len(core)
    assert found(normals.orient(frame(spark, core), seed, (0.0, 0.0, 1.0), spacing), core) == want


def test_jobs_follow_batches_of_levels(spark, monkeypatch):
    """A strip of 60 samples has 59 levels: four batches of 16, so five rounds at most."""
    calls, plain = [], waves.tiled
    monkeypatch.setattr(waves, "tiled", lambda *a: (calls.append(1), plain(*a))[1])
    core = {(i, 0, 0): (0.0, 0.0, 1.0) for i in range(60)} | {(i, 1, 0): (0.0, 0.0, -1.0) for i in range(60)}
    oriented = normals.orient(frame(spark, core), (0, 0, 0), (0.0, 0.0, 1.0))
    assert oriented.where("oriented AND nz > 0.99").count() == 120 and oriented.agg(F.max("depth")).first()[0] == 59
    assert len(calls) <= 2 * 5 + 5


@pytest.mark.parametrize("options", [{}, {"most_mm": 9_000.0}, {"cap": 40}, {"cap": 1}])
def test_flips_are_those_of_a_plain_chain(spark, options):
    core, spacing = wavy(36, 20, seed=5, turned=0.03), (1.0, 1.0, 1.0)
    start = (10, 5, next(z for x, y, z in core if (x, y) == (10, 5)))
    done, stops = plain_flip(core, start, spacing, **options)
    rows = normals.flip_preview(frame(spark, core), start, spacing, **options).collect()
    if stops == "capped":
        assert {r.role for r in rows} == {"capped"} and {r.node: (r.parent, r.depth) for r in rows} == {key(p): s for p, s in done.items()}
        return
    assert {r.node: (r.parent, r.depth) for r in rows if r.role == "affected"} == {key(p): s for p, s in done.items()}
    assert {r.node: r.reason for r in rows if r.role == "boundary"} == {key(p): waves.REASONS[k] for p, k in stops.items()} and len(done) > 100


def test_nothing_to_spread(spark):
    core = frame(spark, {(0, 0, 0): (0.0, 0.0, 1.0), (5, 5, 5): (0.0, 1.0, 0.0)})
    assert normals.orient(core, (9, 9, 9), (0.0, 0.0, 1.0)).where("oriented").count() == 0
    assert normals.orient(core.where("false"), (0, 0, 0), (0.0, 0.0, 1.0)).count() == 0
    assert normals.flip_preview(core, (9, 9, 9)).count() == 0
    twice = core.unionByName(core)
    assert normals.orient(twice, (0, 0, 0), (0.0, 0.0, -1.0)).where("oriented AND nz < 0").count() == 1
