"""Queries on probes, projected meshes, capsule searches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import bricks, recon, target
from isovane.operators.stencil import KEY
from isovane.plans.lineage import cut
from isovane.plans.ranks import numbered
from isovane.queries.normal_fields import _normals, _samples
from isovane.queries.surface import ALL_SAMPLES, LEAF, SX, SY, SZ, VOX, _grid, _morton, _with
from isovane.sources import voxels as v


def probes(spark, sf_dir) -> DataFrame:
    grid, iso = _grid(spark, sf_dir)
    at = g.to_world(grid, F.col("x") + 0.25, F.col("y") + 0.125, F.col("z") + 0.25)
    points = target.core_voxels(grid, iso).select(target.pack_key(*map(F.col, KEY)).alias("pid"), *[c.alias(w) for c, w in zip(at, recon.W, strict=True)])
    return recon.probe(grid, cut(points), iso, rounds=4, tolerance=0.5)


def located(spark, sf_dir) -> DataFrame:
    grid, field = _normals(spark, sf_dir)
    return recon.located(grid, cut(field), v.level_of(grid)).groupBy("core").agg(F.count("*").alias("n"), F.count("component").alias("with_component"), F.countDistinct("component").alias("components"))


def reconstructed(spark, sf_dir) -> DataFrame:
    grid, field = _normals(spark, sf_dir)
    iso = v.level_of(grid)
    return recon.reconstruct(grid, cut(field), recon.MlsSettings(iso=iso, radius=1.5, max_move=0.3))[2]


def capsule(spark, sf_dir) -> DataFrame:
    grid = v.from_lineitem(spark, sf_dir)
    return recon.capsule_leaves(bricks.leaves(grid.voxels), grid, (0.5, 0.5, 2.0), (4.0, 1.0, 9.0), 2.0).select("bi", "bj", "bk", F.round("d2", 6).alias("d2"))


def capsule_table(spark, sf_dir) -> DataFrame:
    """A capsule for each customer, those of a nation united, against the leaves of the volume."""
    key, grid = F.col("c_custkey"), v.from_lineitem(spark, sf_dir)
    ends = {"ax": key % 97 * 0.07, "ay": key % 31 * 0.1, "az": key % 29 * 1.0, "bx": key % 83 * 0.09, "by": key % 37 * 0.09, "bz": key % 23 * 1.3, "radius": key % 5 * 0.15}
    capsules = v.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sid"), *[c.alias(n) for n, c in ends.items()])
    return recon.capsule_table(bricks.leaves(grid.voxels), grid, capsules).select("sid", "bi", "bj", "bk", F.round("d2", 6).alias("d2"))


def morton_order(spark, sf_dir) -> DataFrame:
    found = bricks.from_grid(v.from_lineitem(spark, sf_dir)).select("bi", "bj", "bk", "morton")
    return numbered(found, ["morton", "bi", "bj", "bk"], "place").select("bi", "bj", "bk", F.col("place").cast("int").alias("place"))


def metrics(spark, sf_dir) -> DataFrame:
    _, iso, samples = _samples(spark, sf_dir)
    core = F.col("kind") == "core"
    return samples.agg(
        F.lit(iso).alias("iso"), F.count("*").alias("samples"), F.count_if(core).alias("core"), F.count_if(~core).alias("transition"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.round(F.avg(F.when(core, F.col("value"))), 6).alias("mean_core"), F.round(F.sum("support"), 4).alias("support"),
    )


QUERIES = {
    "g16_h15_probes": probes, "g2_located": located, "g17_h18_d25_reconstructed": reconstructed, "b25_c20_h17_capsule": capsule, "c20_capsule_table": capsule_table, "e5_morton_order": morton_order, "a24_metrics": metrics,
}



def _capsule_sql(capsules: str, keys: str) -> str:
    """Every capsule against every leaf: the least value on each piece between the sides of the box, at an end or where the slope is 0."""
    size, axes = [8 * s for s in (SX, SY, SZ)], list(zip("xyz", ("bi", "bj", "bk"), (SX, SY, SZ), strict=True))
    boxes = "box AS (SELECT DISTINCT bi, bj, bk, " + ", ".join(f"{b} * {s}::DOUBLE AS l{k}, {b} * {s}::DOUBLE + {7 * t}::DOUBLE AS h{k}" for (k, b, t), s in zip(axes, size, strict=True)) + " FROM leaf)"
    pairs = "pair AS (SELECT *, row_number() OVER () AS r, bx - ax AS sx, by_ - ay AS sy, bz - az AS sz FROM cap CROSS JOIN box)"
    marks = ", ".join(f"CASE WHEN s{k} <> 0 THEN least(greatest(({m}{k} - a{k}) / s{k}, 0), 1) ELSE 0 END" for k in "xyz" for m in "lh")
    gap = {k: f"(CASE WHEN a{k} + s{k} * m < l{k} THEN a{k} - l{k} WHEN a{k} + s{k} * m > h{k} THEN a{k} - h{k} END)" for k in "xyz"}
    slope, bend = " + ".join(f"coalesce({c} * s{k}, 0)" for k, c in gap.items()), " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE s{k} * s{k} END" for k, c in gap.items())
    away = " + ".join(f"pow(greatest(l{k} - (a{k} + s{k} * t), (a{k} + s{k} * t) - h{k}, 0), 2)" for k in "xyz")
    return f"""{_with(VOX, LEAF)}, {capsules}, {boxes}, {pairs},
      ends AS (SELECT *, list_sort([0.0::DOUBLE, 1.0::DOUBLE, {marks}]) AS ts FROM pair),
      part AS (SELECT *, ts[i] AS t0, ts[i + 1] AS t1, (ts[i] + ts[i + 1]) / 2 AS m FROM (SELECT *, unnest(range(1, 8)) AS i FROM ends)),
      bent AS (SELECT *, {slope} AS slope, {bend} AS bend FROM part),
      tried AS (SELECT *, unnest([t0, t1, CASE WHEN bend > 0 THEN least(greatest(-slope / bend, t0), t1) ELSE t0 END]) AS t FROM bent),
      one AS (SELECT r, any_value(radius) AS radius, {', '.join(f'any_value({k}) AS {k}' for k in keys.split(', '))}, min({away}) AS d2 FROM tried GROUP BY r)
      SELECT {keys}, round(min(d2), 6) AS d2 FROM one WHERE d2 <= radius * radius GROUP BY {keys}"""


CUSTOMER_CAPSULES = """cap AS (SELECT c_nationkey AS sid, c_custkey % 97 * 0.07::DOUBLE AS ax, c_custkey % 31 * 0.1::DOUBLE AS ay, c_custkey % 29 * 1.0::DOUBLE AS az,
  c_custkey % 83 * 0.09::DOUBLE AS bx, c_custkey % 37 * 0.09::DOUBLE AS by_, c_custkey % 23 * 1.3::DOUBLE AS bz, c_custkey % 5 * 0.15::DOUBLE AS radius FROM customer)"""
ONE_CAPSULE = "cap AS (SELECT 0.5::DOUBLE AS ax, 0.5::DOUBLE AS ay, 2.0::DOUBLE AS az, 4.0::DOUBLE AS bx, 1.0::DOUBLE AS by_, 9.0::DOUBLE AS bz, 2.0::DOUBLE AS radius)"

SQL = {
    "c20_capsule_table": _capsule_sql(CUSTOMER_CAPSULES, "sid, bi, bj, bk"),
    "b25_c20_h17_capsule": _capsule_sql(ONE_CAPSULE, "bi, bj, bk"),
    "e5_morton_order": _with(VOX, LEAF) + f""", low AS (SELECT min(bi) AS mx, min(bj) AS my, min(bk) AS mz FROM leaf), b AS (SELECT DISTINCT bi, bj, bk FROM leaf)
      SELECT bi, bj, bk, CAST(row_number() OVER (ORDER BY {_morton('bi - mx', 'bj - my', 'bk - mz')}) - 1 AS INTEGER) AS place FROM b, low""",
    "a24_metrics": _with(*ALL_SAMPLES) + """ SELECT (SELECT iso FROM iso) AS iso, count(*) AS samples, count(*) FILTER (WHERE kind = 'core') AS core, count(*) FILTER (WHERE kind <> 'core') AS transition,
      min(value) AS least, max(value) AS most, round(avg(value) FILTER (WHERE kind = 'core'), 6) AS mean_core, round(sum(support), 4) AS support FROM samples""",
}
