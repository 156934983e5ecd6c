"""Queries on stores, and on lines of files beside a grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.operators import strokes, target
from isovane.plans.lineage import ensure_checkpoint_dir
from isovane.queries.fields import W, _weights, nearest_seed
from isovane.queries.normal_fields import _samples
from isovane.queries.surface import ALL_SAMPLES, CORE, SIX, SX, SY, SZ, VOX, _grid, _with
from isovane.sources import sidecars, stores, versions
from isovane.sources import voxels as v

#: The place that ``nearest_seed`` asks for.
SEEN = (3.0, 1.5, 12.25)


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4()}"


def sample_store(spark, sf_dir) -> DataFrame:
    """All samples of the volume, saved and loaded again for the same grid and settings."""
    grid, iso, samples = _samples(spark, sf_dir)
    store, facts = versions.Store(spark, _folder(spark), "samples", by="kind"), versions.grid_facts(grid, "lineitem", iso=iso, layers=2)
    return store.load_or(facts, lambda: samples.select("x", "y", "z", "kind", "value"))


def weight_library(spark, sf_dir) -> DataFrame:
    """Painted weights of two halves, the second committed over the first, loaded from their library with what the listing says."""
    grid, library, painted = v.from_lineitem(spark, sf_dir), _folder(spark), _weights(spark, sf_dir)
    first = versions.save_weights(library, "painted", strokes.merge_weights(painted.where("y % 2 = 0")), grid, "lineitem")
    before = versions.load_weights(spark, library, "painted", grid, "lineitem")
    versions.save_weights(library, "painted", strokes.merge_weights(before, painted.where("y % 2 = 1")), grid, "lineitem", after=first)
    listing = versions.list_weights(spark, library).select("name", "version", "rows")  # one row for each field
    return versions.load_weights(spark, library, "painted", grid, "lineitem").crossJoin(F.broadcast(listing))


def _events(spark, sf_dir) -> DataFrame:
    return v.table(spark, sf_dir, "events").select("event_id", "user_id", "value")


def seed_lines(spark, sf_dir) -> DataFrame:
    """A seed line for each event, some broken, foreign or without length."""
    e = F.col("event_id")
    parts = F.struct(
        F.when(e % 11 == 0, 2).otherwise(1).alias("schema"), F.when(e % 5 == 0, "b").otherwise("a").alias("source"), F.lit("density").alias("grid"), (F.lit(255.0) + F.when(e % 3 == 0, 1.0).otherwise(0.0001)).alias("iso"), (e % 13 != 0).alias("valid"),
        F.array(e % 24, F.col("user_id") % 10, F.lit(1)).alias("coordinate"), F.array(F.col("value"), F.lit(0.0), F.lit(1.0)).alias("world"), F.array((e % 7).cast("double"), F.lit(0.0), F.lit(0.0)).alias("normal"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("ray_direction"),
    )
    text = F.to_json(parts)
    lines = _events(spark, sf_dir).select("event_id", F.when(e % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))
    return sidecars.seeds(lines, "a", "density", 255.0).select("event_id", "refusal")


def flip_lines(spark, sf_dir) -> DataFrame:
    """A flip point for each event, with rows of the older kind, of another kind, and signs that are too large."""
    e = F.col("event_id")
    kind = F.when(e % 7 == 0, "seed").when(e % 11 == 0, "other").otherwise("flip_point")
    parts = F.struct(F.lit(1).alias("schema"), kind.alias("kind"), F.array(e % 24, -(F.col("user_id") % 10), F.lit(1)).alias("coordinate"), (e % 260).alias("target_sign"), F.when(e % 3 != 0, (e % 2).cast("int")).alias("accepted"))
    found = sidecars.flips(_events(spark, sf_dir).select("event_id", F.to_json(parts).alias("value")))
    return found.select("event_id", "x", "y", "z", F.col("target_sign").cast("int").alias("target_sign"), "active", "accepted", "valid")


def pick_report(spark, sf_dir) -> DataFrame:
    """Reports on one place as JSON lines, read back: the source, the place, the core voxel nearest to it and its sample."""
    grid, iso = _grid(spark, sf_dir)
    core = target.core_voxels(grid, iso)
    at = [F.lit(s).alias(w) for s, w in zip(SEEN, ("wx", "wy", "wz"), strict=True)]
    one = spark.range(1)
    near = nearest_seed(spark, sf_dir).select("x", "y", "z")
    world = [c.alias(w) for c, w in zip(g.to_world(grid, F.col("x"), F.col("y"), F.col("z")), ("wx", "wy", "wz"), strict=True)]
    report = stores.pick_report(one.select(F.lit("density").alias("grid"), F.lit(float(iso)).alias("iso")), one.select(*at), near.select("x", "y", "z", *world), near.join(core, ["x", "y", "z"]).select("x", "y", "z", "value"))
    read = lambda n, kind: F.get_json_object("record", f"$.{n}").cast(kind)
    return report.select("stage", read("iso", "double").alias("iso"), *[read(k, "int").alias(k) for k in "xyz"], *[F.round(read(f"w{k}_mm", "double"), 3).alias(f"w{k}_mm") for k in "xyz"], read("value", "double").alias("value"))


QUERIES = {"a8_a9_sample_store": sample_store, "a11_a12_a13_weight_library": weight_library, "a15_seed_lines": seed_lines, "a16_flip_lines": flip_lines, "a22_pick_report": pick_report}

SQL = {
    "a8_a9_sample_store": _with(*ALL_SAMPLES) + " SELECT x, y, z, kind, value FROM samples",
    "a11_a12_a13_weight_library": f"WITH {W} SELECT m.*, 'painted' AS name, 2 AS version, (SELECT count(*) FROM m) AS rows FROM m",
    "a15_seed_lines": """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN 'incomplete' WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'foreign' WHEN event_id % 7 = 0 THEN 'vectors' END AS refusal FROM events""",
    "a16_flip_lines": """SELECT event_id, CAST(event_id % 24 AS INTEGER) AS x, CAST(-(user_id % 10) AS INTEGER) AS y, 1 AS z, CAST(event_id % 260 AS INTEGER) AS target_sign, event_id % 7 <> 0 AND event_id % 11 <> 0 AS active,
      event_id % 3 = 0 OR event_id % 2 = 1 AS accepted, (event_id % 7 = 0 OR event_id % 11 <> 0) AND event_id % 260 <= 255 AS valid FROM events""",
    "a22_pick_report": _with(VOX, SIX, CORE) + f""", near AS (SELECT x, y, z, value FROM core ORDER BY (x*{SX}::DOUBLE - {SEEN[0]})**2 + (y*{SY}::DOUBLE - {SEEN[1]})**2 + (z*{SZ}::DOUBLE - {SEEN[2]})**2, x, y, z LIMIT 1)
      SELECT 'source' AS stage, (SELECT iso FROM iso) AS iso, NULL::INTEGER AS x, NULL::INTEGER AS y, NULL::INTEGER AS z, NULL::DOUBLE AS wx_mm, NULL::DOUBLE AS wy_mm, NULL::DOUBLE AS wz_mm, NULL::DOUBLE AS value
      UNION ALL SELECT 'pick', NULL, NULL, NULL, NULL, {SEEN[0] * 1000}::DOUBLE, {SEEN[1] * 1000}::DOUBLE, {SEEN[2] * 1000}::DOUBLE, NULL
      UNION ALL SELECT 'surface', NULL, x, y, z, round(x*{SX}::DOUBLE*1000, 3), round(y*{SY}::DOUBLE*1000, 3), round(z*{SZ}::DOUBLE*1000, 3), NULL FROM near
      UNION ALL SELECT 'target', NULL, x, y, z, NULL, NULL, NULL, value FROM near""",
}
