"""Column expressions for vectors, kernels, interpolation and colours; all stay in generated JVM code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
TINY = 1e-20


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a: Vector, b: Vector) -> Vector:
    return (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def vector(*names: str) -> Vector:
    a, b, c = names
    return (F.col(a), F.col(b), F.col(c))


def normalized(a: Vector) -> Vector:
    """Unit vector; zero where the length is 1e-20 or less, or not finite."""
    n = length(a)
    good = (n > TINY) & (n < float("inf"))
    return tuple(F.when(good, c / n).otherwise(F.lit(0.0)) for c in a)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def to_world(grid, x: Column, y: Column, z: Column) -> Vector:
    """World position of a voxel centre."""
    return tuple(F.lit(o) + F.lit(s) * c for c, s, o in zip((x, y, z), grid.spacing, grid.origin, strict=True))


def to_index(grid, wx: Column, wy: Column, wz: Column) -> Vector:
    return tuple((c - F.lit(o)) / F.lit(s) for c, s, o in zip((wx, wy, wz), grid.spacing, grid.origin, strict=True))


def nearest(value: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("int")


def crossing(center: Column, neighbour: Column, iso: float) -> Column:
    """Where the value passes ``iso`` on the way to a neighbour, 0 to 1; 0.5 where both are equal."""
    step = neighbour - center
    return F.when(F.abs(step) > 1e-12, clamp((F.lit(float(iso)) - center) / step, 0, 1)).otherwise(F.lit(0.5))


def transition_support(value: Column, layer: Column, iso: float, layers: int, fog: bool = True) -> Column:
    """1 less the share of layers passed, in fog times the share of iso reached."""
    share = 1.0 - layer / F.lit(float(max(1, layers + 1)))
    reached = clamp(value / F.lit(float(iso)), 0, 1) if fog and iso > TINY else F.lit(1.0)
    return clamp(share * reached, 0, 1)


def wendland(q: Column) -> Column:
    """(1 - q)^4 (4 q + 1) below 1, else 0."""
    r = 1.0 - q
    return F.when(q < 1.0, r * r * r * r * (4.0 * q + 1.0)).otherwise(F.lit(0.0))


def falloff(distance: Column, core: float, width: float) -> Column:
    """Brush weight: 1 up to ``core``, then a smooth step to 0 over ``width``."""
    t = clamp((distance - F.lit(float(core))) / F.lit(float(max(width, 1e-12))), 0, 1)
    return F.when(distance <= float(core), F.lit(1.0)).otherwise(1.0 - t * t * t * (t * (t * 6.0 - 15.0) + 10.0))


def edge_cost(delta: Vector, n1: Vector, n2: Vector, p1: Column, p2: Column, plane_penalty: float = 16.0, normal_penalty: float = 0.5, scale: float = math.radians(20)) -> Column:
    """Cost of a step between two samples: its length, more where it leaves the plane of the mean normal or normals turn."""
    size = length(delta)
    both = tuple(a + b for a, b in zip(n1, n2, strict=True))
    opposed = dot(both, both) <= TINY
    mean = tuple(F.when(opposed, a).otherwise(c) for a, c in zip(n1, normalized(both), strict=True))
    offset = F.abs(dot(delta, mean)) / size
    turn = F.acos(clamp(dot(n1, n2), -1, 1)) / F.lit(scale)
    bend = F.lit(plane_penalty) * offset * offset + F.lit(normal_penalty) * turn * turn
    return F.when(size > TINY, size * (1.0 + F.sqrt(p1 * p2) * bend)).otherwise(F.lit(float("inf")))


def voxel_area(n: Vector, spacing: tuple[float, float, float]) -> Column:
    """Area in mm2 of the tangent plane with unit normal ``n`` in a voxel: its volume over its extent along the normal."""
    extent = sum(F.abs(c) * F.lit(float(s)) for c, s in zip(n, spacing, strict=True))
    return F.lit(math.prod(spacing) * 1e6) / extent


def continues(delta: Vector, n1: Vector, n2: Vector, most: float = 0.75) -> Column:
    """Whether a step stays near the tangent planes of both normals; false for zero steps or normals."""
    good = (dot(delta, delta) > TINY) & (dot(n1, n1) > TINY) & (dot(n2, n2) > TINY)
    step, a, b = normalized(delta), normalized(n1), normalized(n2)
    return F.coalesce(good & (F.greatest(F.abs(dot(step, a)), F.abs(dot(step, b))) <= most), F.lit(False))


def spread21(v: Column) -> Column:
    """The low 21 bits of a long, two zero bits after each."""
    v = v.cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 3 * i) for i in range(21)])


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Morton key of coordinates from 0 to 2^21 - 1, x in the lowest bits."""
    return spread21(x).bitwiseOR(F.shiftleft(spread21(y), 1)).bitwiseOR(F.shiftleft(spread21(z), 2))


def gray(value: Column, most: float | Column) -> Column:
    """0 to 255, rounded half up."""
    top = F.lit(float(most)) if isinstance(most, (int, float)) else most
    share = F.when(top > 0, clamp(value / top, 0, 1)).otherwise(F.lit(0.0))
    return F.floor(share * 255.0 + 0.5).cast("int")


def heat_color(heat: Column) -> tuple[Column, Column, Column, Column]:
    """Red, green, blue and alpha, 0 to 255; nothing for heat of 0 or less.

    Blue fades out and red comes in over opposite halves, green peaks in the middle, alpha goes from 0.55 to 1.
    """
    t = clamp(heat, 0, 1)
    ramps = (clamp(2.0 * t, 0, 1), clamp(2.0 - F.abs(4.0 * t - 2.0), 0, 1), clamp(2.0 * (1.0 - t), 0, 1), 0.55 + 0.45 * t)
    return tuple(F.when(heat > 0, F.floor(c * 255.0 + 0.5)).otherwise(F.lit(0)).cast("int") for c in ramps)


def triangle_normal(a: Vector, b: Vector, c: Vector) -> Vector:
    """Cross product of two sides: twice the area along the face normal."""
    return cross(minus(b, a), minus(c, a))


def same_float(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal relative to the larger of 1 and both magnitudes."""
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def point_triangle_d2(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Squared distance from a point to a triangle: the face where the foot lies in it, else the nearest edge."""

    def segment(u: Vector, v: Vector) -> Column:
        side, rel = minus(v, u), minus(p, u)
        size = dot(side, side)
        t = F.when(size > TINY, clamp(dot(rel, side) / size, 0, 1)).otherwise(F.lit(0.0))
        gap = tuple(r - t * s for r, s in zip(rel, side, strict=True))
        return dot(gap, gap)

    n = triangle_normal(a, b, c)
    area2 = dot(n, n)
    within = reduce(lambda x, y: x & y, [dot(cross(minus(v, u), minus(p, u)), n) >= 0 for u, v in ((a, b), (b, c), (c, a))])
    height = dot(minus(p, a), n)
    edges = F.least(segment(a, b), segment(b, c), segment(c, a))
    return F.when((area2 > TINY) & within, height * height / area2).otherwise(edges)


def ray_box(origin: tuple[float, float, float], direction: tuple[float, float, float], low: Vector, high: Vector) -> tuple[Column, Column]:
    """Entry and exit distance of a ray through a box by slabs; they miss where entry > exit."""
    near, far = F.lit(0.0), F.lit(float("inf"))
    for o, d, lo, hi in zip(origin, direction, low, high, strict=True):
        if d == 0:
            out = (lo > o) | (hi < o)
            near = F.when(out, F.lit(float("inf"))).otherwise(near)
        else:
            t1, t2 = (lo - o) / F.lit(float(d)), (hi - o) / F.lit(float(d))
            near, far = F.greatest(near, F.least(t1, t2)), F.least(far, F.greatest(t1, t2))
    return near, far


def ray_triangle(origin: tuple[float, float, float], direction: tuple[float, float, float], a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    """hit_triangle() for one ray."""
    return hit_triangle(tuple(F.lit(float(v)) for v in origin), tuple(F.lit(float(v)) for v in direction), a, b, c)


def hit_triangle(o: Vector, d: Vector, a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    """(distance, u, v) of a ray's hit with a triangle; distance is null where it misses."""
    e1, e2 = minus(b, a), minus(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = minus(o, a)
    u = dot(s, h) / det
    q = cross(s, e1)
    v, t = dot(d, q) / det, dot(e2, q) / det
    hit = (F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0)
    return F.when(hit, t), u, v


def encode_cell(i: Column, j: Column, k: Column, shape: tuple[int, int, int]) -> Column:
    """Number of a cell in a local block, the first axis fastest."""
    return i + F.lit(shape[0]) * (j + F.lit(shape[1]) * k)


def decode_cell(n: Column, shape: tuple[int, int, int]) -> Vector:
    return (n % shape[0], F.floor(n / shape[0]) % shape[1], F.floor(n / (shape[0] * shape[1])))
