"""Queries on neighbourhoods, fitted and oriented normals, and adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.functions import linalg
from isovane.operators import normals, target, tiles
from isovane.operators.stencil import KEY, box, half_box
from isovane.plans.lineage import cut
from isovane.queries.surface import ALL_SAMPLES, BOX, CORE, NORMALS, REACH, SIX, SX, SY, SZ, VOX, _grid, _settings, _values, _with, r6


def _samples(spark, sf_dir):
    grid, iso = _grid(spark, sf_dir)
    rows = target.classified(grid, _settings(iso))
    world = g.to_world(grid, *map(F.col, KEY))
    return grid, iso, cut(rows.select(*KEY, "kind", *[c.alias(n) for c, n in zip(world, ("wx", "wy", "wz"), strict=True)], "support", "value"))


def _normals(spark, sf_dir):
    """Normals rounded to 6 places, so that both engines classify the same edges."""
    grid, iso = _grid(spark, sf_dir)
    world = g.to_world(grid, *map(F.col, KEY))
    placed = [c.alias(n) for c, n in zip(world, ("wx", "wy", "wz"), strict=True)]
    found = cut(tiles.surface(grid, _settings(iso)))
    return grid, found.select(*KEY, "kind", *placed, "support", "value", *[r6(F.col(n)).alias(n) for n in ("nx", "ny", "nz")])


def half_edges(spark, sf_dir) -> DataFrame:
    _, field = _normals(spark, sf_dir)
    found = normals.adjacency(field)
    return found.select(*KEY, "qx", "qy", "qz", "kind", "n_kind", (F.round("aligned", 4) + F.lit(0.0)).alias("aligned"))


def statistics(spark, sf_dir) -> DataFrame:
    _, field = _normals(spark, sf_dir)
    pairs = normals.adjacency(field).withColumn("aligned", F.round("aligned", 5))
    core = (F.col("kind") == "core") & (F.col("n_kind") == "core")
    return pairs.agg(
        F.count_if(core).alias("core_edges"), F.count_if(core & (F.col("aligned") < 0)).alias("core_opposing"), F.count_if(core & (F.abs("aligned") < 0.15)).alias("core_weak"),
        F.round(F.avg(F.when(core, F.col("aligned"))), 4).alias("mean_signed"), F.round(F.avg(F.when(core, F.abs("aligned"))), 4).alias("mean_absolute"), F.count_if(~core).alias("transition_edges"),
    )


def full_statistics(spark, sf_dir) -> DataFrame:
    return normals.adjacency_statistics(_normals(spark, sf_dir)[1])


def valid_components(spark, sf_dir) -> DataFrame:
    found = normals.valid_components(_normals(spark, sf_dir)[1])
    first = target.unpack_key(F.col("component"))
    return found.select(*KEY, *[c.alias(n) for c, n in zip(first, ("cx", "cy", "cz"), strict=True)])


def worst_edges(spark, sf_dir) -> DataFrame:
    found = normals.worst_edges(_normals(spark, sf_dir)[1])
    return found.select("class", *KEY, "qx", "qy", "qz", F.round("aligned", 4).alias("aligned"))


def supported(spark, sf_dir) -> DataFrame:
    return normals.supported_transitions(_normals(spark, sf_dir)[1])


def box_ranked(spark, sf_dir) -> DataFrame:
    grid, iso, samples = _samples(spark, sf_dir)
    core = samples.where("kind = 'core'").select(*KEY)
    found = normals.box_neighbourhood(core, core.withColumn("one", F.lit(1)), 2, 25)
    return found.select(*KEY, "qx", "qy", "qz", "hops", "rank")


def connected_ranked(spark, sf_dir) -> DataFrame:
    grid, iso, samples = _samples(spark, sf_dir)
    found = normals.connected_neighbourhood(samples.where("kind = 'core'"), 2, 25)
    return found.select(*KEY, "qx", "qy", "qz", "hops", "rank")


def covariances(spark, sf_dir) -> DataFrame:
    grid, iso, samples = _samples(spark, sf_dir)
    core = samples.where("kind = 'core'").select(*KEY)
    near = normals.box_neighbourhood(core, core.withColumn("one", F.lit(1)), 1, 9)
    w = 1.0 / (1.0 + 0.5 * F.col("hops"))
    p = [F.col(q) * F.lit(s) for q, s in zip(("qx", "qy", "qz"), (SX, SY, SZ), strict=True)]
    sums = near.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"p{i}") for i, c in enumerate(p)], *[F.sum(w * p[a] * p[b]).alias(f"m{i}") for i, (a, b) in enumerate(linalg.UPPER3)])
    cov = [(F.col(f"m{i}") - F.col(f"p{a}") * F.col(f"p{b}") / F.col("w")).alias(f"c{i}") for i, (a, b) in enumerate(linalg.UPPER3)]
    return sums.select(*KEY, "n", *cov)


def rounded_covariances(spark, sf_dir) -> DataFrame:
    found = covariances(spark, sf_dir)
    return found.select(*KEY, "n", *[r6(F.col(f"c{i}")).alias(f"c{i}") for i in range(6)])


def eigen_axes(spark, sf_dir) -> DataFrame:
    found = covariances(spark, sf_dir).where("n >= 3")
    return linalg.eigenvector(found, [f"c{i}" for i in range(6)], ("nx", "ny", "nz"), largest=False).select(*KEY, *[r6(F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


def tensors(spark, sf_dir) -> DataFrame:
    _, field = _normals(spark, sf_dir)
    near = normals.box_neighbourhood(field.where("kind = 'core'").select(*KEY), field.where("kind = 'core'").select(*KEY, "nx", "ny", "nz"), 1, 9)
    found = near.groupBy(*KEY).agg(*linalg.tensor_sums(1.0 / (1.0 + F.col("hops")), g.vector("n_nx", "n_ny", "n_nz")))
    return found.select(*KEY, *[(F.round(F.col(f"m{i}"), 5) + F.lit(0.0)).alias(f"m{i}") for i in range(6)])


def fitted(spark, sf_dir) -> DataFrame:
    _, _, samples = _samples(spark, sf_dir)
    return normals.fit(samples, "5x5").select(*KEY, "kind", *[F.round(F.col(c), 4).alias(c) for c in ("nx", "ny", "nz")])


def smoothed(spark, sf_dir) -> DataFrame:
    _, _, samples = _samples(spark, sf_dir)
    return normals.smooth(normals.fit(samples, "3x3"), "3x3").select(*KEY, "kind", *[F.round(F.col(c), 4).alias(c) for c in ("nx", "ny", "nz")])


def _first(rows: DataFrame) -> tuple[int, int, int] | None:
    """The first place in (x, y, z) order; None where there are no rows, as on a surface that nothing crosses."""
    row = rows.select(*KEY).orderBy(*KEY).limit(1).first()
    return row and tuple(row)


def _oriented(spark, sf_dir):
    grid, iso, samples = _samples(spark, sf_dir)
    field = cut(normals.fit(samples, "5x5"))
    return grid, field, normals.orient(field, _first(samples.where("kind = 'core'")), (1.0, 0.0, 0.0), grid.spacing)


def oriented(spark, sf_dir) -> DataFrame:
    return _oriented(spark, sf_dir)[2]


def flip_chain(spark, sf_dir) -> DataFrame:
    grid, _, field = _oriented(spark, sf_dir)
    field = cut(field)
    return normals.flip_preview(field, _first(field.where("kind = 'core' AND oriented AND depth = 1")), grid.spacing)


QUERIES = {
    "c3_half_edges": half_edges, "d10_statistics": statistics, "h6_full_statistics": full_statistics, "g4_valid_components": valid_components, "e4_worst_edges": worst_edges, "c8_supported_transitions": supported,
    "c11_e1_box_neighbourhoods": box_ranked, "c10_h8_connected_neighbourhoods": connected_ranked, "d4_covariances": rounded_covariances, "b19_eigen_axes": eigen_axes,
    "b20_d6_tensors": tensors, "h3_d5_fitted_normals": fitted, "h4_smoothed_normals": smoothed, "g9_h5_oriented_normals": oriented, "g12_h7_flip_chain": flip_chain,
}

ROUNDED = "field AS MATERIALIZED (SELECT x, y, z, kind, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM normals)"
HALF = _values(half_box(), "half13")
UNIT = "unit AS MATERIALIZED (SELECT x, y, z, kind, nx / l AS nx, ny / l AS ny, nz / l AS nz FROM (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS l FROM field) WHERE l > 1e-20)"
EDGES = """pairs AS (SELECT a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS qz, a.kind, b.kind AS n_kind, least(greatest(a.nx*b.nx + a.ny*b.ny + a.nz*b.nz, -1), 1) AS aligned
  FROM unit a CROSS JOIN half13 o JOIN unit b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz)"""
FIELD = (*ALL_SAMPLES, NORMALS, ROUNDED, HALF, UNIT, EDGES)


def _box_sql(half: int, most: int) -> str:
    return _values(box(half, center=True), "wide_box") + f""",
    ranked AS (SELECT a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS qz, greatest(abs(o.dx), abs(o.dy), abs(o.dz)) AS hops,
      CAST(row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY greatest(abs(o.dx), abs(o.dy), abs(o.dz)), o.dx*o.dx + o.dy*o.dy + o.dz*o.dz, b.x, b.y, b.z) AS INTEGER) AS rank
      FROM core a CROSS JOIN wide_box o JOIN core b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz QUALIFY rank <= {most})"""


CONNECTED = """link AS (SELECT a.x, a.y, a.z, b.x AS qx, b.y AS qy, b.z AS qz FROM core a CROSS JOIN box26 o JOIN core b ON b.x = a.x + o.dx AND b.y = a.y + o.dy AND b.z = a.z + o.dz),
two AS (
  SELECT x, y, z, x AS qx, y AS qy, z AS qz, 0 AS hops FROM core
  UNION ALL SELECT x, y, z, qx, qy, qz, 1 FROM link
  UNION ALL SELECT a.x, a.y, a.z, b.qx, b.qy, b.qz, 2 FROM link a JOIN link b ON b.x = a.qx AND b.y = a.qy AND b.z = a.qz),
least_ AS (SELECT x, y, z, qx, qy, qz, min(hops) AS hops FROM two GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY x, y, z ORDER BY hops, (qx-x)*(qx-x) + (qy-y)*(qy-y) + (qz-z)*(qz-z), qx, qy, qz) AS INTEGER) AS rank FROM least_ QUALIFY rank <= 25)"""
_P = [f"{q} * {s}::DOUBLE" for q, s in zip(("qx", "qy", "qz"), (SX, SY, SZ), strict=True)]
_W = "(1.0::DOUBLE / (1 + 0.5 * hops))"

#: REACH over core samples that have a normal.
VALID_REACH = "vcore AS MATERIALIZED (SELECT x, y, z FROM field WHERE kind = 'core' AND nx*nx + ny*ny + nz*nz > 1e-20)," + REACH.replace("core ", "vcore ").replace("FROM core\n", "FROM vcore\n")

SQL = {
    "g4_valid_components": _with(*ALL_SAMPLES, NORMALS, ROUNDED, BOX, VALID_REACH) + " SELECT CAST(node // 10000 AS INTEGER) AS x, CAST(node // 100 % 100 AS INTEGER) AS y, CAST(node % 100 AS INTEGER) AS z, CAST(label // 10000 AS INTEGER) AS cx, CAST(label // 100 % 100 AS INTEGER) AS cy, CAST(label % 100 AS INTEGER) AS cz FROM comp",
    "c3_half_edges": _with(*FIELD) + " SELECT x, y, z, qx, qy, qz, kind, n_kind, round(aligned, 4) + 0.0 AS aligned FROM pairs",
    "e4_worst_edges": _with(*FIELD) + """, c AS (SELECT *, CASE WHEN kind = 'core' AND n_kind = 'core' THEN 'core' ELSE 'transition' END AS class FROM pairs WHERE aligned < 0)
      SELECT class, x, y, z, qx, qy, qz, round(aligned, 4) AS aligned FROM c QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(aligned, 9), x, y, z, qx, qy, qz) <= 12""",
    "d10_statistics": _with(*FIELD) + """ SELECT count(*) FILTER (WHERE c) AS core_edges, count(*) FILTER (WHERE c AND a < 0) AS core_opposing, count(*) FILTER (WHERE c AND abs(a) < 0.15) AS core_weak,
      round(avg(a) FILTER (WHERE c), 4) AS mean_signed, round(avg(abs(a)) FILTER (WHERE c), 4) AS mean_absolute, count(*) FILTER (WHERE NOT c) AS transition_edges
      FROM (SELECT round(aligned, 5) AS a, kind = 'core' AND n_kind = 'core' AS c FROM pairs)""",
    "c8_supported_transitions": _with(*FIELD, BOX) + """ SELECT t.x, t.y, t.z, EXISTS (SELECT 1 FROM unit c, box26 o WHERE c.kind = 'core' AND c.x = t.x + o.dx AND c.y = t.y + o.dy AND c.z = t.z + o.dz) AS supported FROM unit t WHERE t.kind = 'transition'""",
    "c11_e1_box_neighbourhoods": _with(VOX, SIX, CORE, _box_sql(2, 25)) + " SELECT * FROM ranked",
    "c10_h8_connected_neighbourhoods": _with(VOX, SIX, CORE, BOX, CONNECTED) + " SELECT x, y, z, qx, qy, qz, hops, rank FROM ranked",
    "d4_covariances": _with(VOX, SIX, CORE, _box_sql(1, 9)) + ", s AS (SELECT x, y, z, count(*) AS n, sum(w) AS w, " + ", ".join(f"sum(w * p{i}) AS p{i}" for i in range(3)) + ", " + ", ".join(f"sum(w * p{a} * p{b}) AS m{i}" for i, (a, b) in enumerate(linalg.UPPER3)) + f" FROM (SELECT x, y, z, {_W} AS w, " + ", ".join(f"{p} AS p{i}" for i, p in enumerate(_P)) + " FROM ranked) GROUP BY x, y, z) SELECT x, y, z, n, " + ", ".join(f"round(m{i} - p{a} * p{b} / w, 6) + 0.0 AS c{i}" for i, (a, b) in enumerate(linalg.UPPER3)) + " FROM s",
    "b20_d6_tensors": _with(*FIELD, _box_sql(1, 9)) + " SELECT x, y, z, " + ", ".join(f"round(sum(w * {'n' + 'xyz'[a]} * {'n' + 'xyz'[b]}), 5) + 0.0 AS m{i}" for i, (a, b) in enumerate(linalg.UPPER3)) + " FROM (SELECT r.x, r.y, r.z, 1.0::DOUBLE / (1 + r.hops) AS w, f.nx, f.ny, f.nz FROM ranked r JOIN field f ON f.x = r.qx AND f.y = r.qy AND f.z = r.qz) GROUP BY x, y, z",
}
