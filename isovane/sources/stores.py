"""Stores beside the data: fingerprints, presets, seeds, flips, stroke logs and catalogues as JSON lines and Parquet."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isovane.functions import geometry as g
from isovane.sources.voxels import Grid

TOLERANCE = 1e-6
FLIP = "x int, y int, z int, target_sign short, kind string, color array<short>, accepted boolean"
STROKE = "schema int, stroke_id string, points array<array<double>>, fits array<array<double>>"
#: Numbers in a fit by version of the stroke log.
FIT_WIDTHS = {1: 14, 2: 16}
#: Brush presets: name, default, least, most.
PRESET = [("core_mm", 5.0, 0.1, 1000.0), ("falloff_mm", 10.0, 0.0, 1000.0), ("strength", 1.0, 0.0, 1.0), ("spacing_mm", 1.0, 0.01, 100.0)]


def fingerprint(grid: Grid, settings: dict[str, float]) -> DataFrame:
    """One row that identifies a grid and settings: class, counts, bounds of active voxels, a hash of all values."""
    keys = ("x", "y", "z")
    facts = [f(F.when(F.col("active"), F.col(k))).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))]
    content = F.bit_xor(F.xxhash64("x", "y", "z", "value", "active"))
    text = json.dumps(settings, sort_keys=True)
    return grid.voxels.agg(F.count("*").alias("n"), F.count_if("active").alias("active"), *facts, content.alias("content")).select(F.lit(grid.name).alias("grid"), F.lit(grid.grid_class).alias("class"), "*", F.lit(text).alias("settings"))


def save_with(df: DataFrame, facts: DataFrame, path: str) -> None:
    """Rows and their fingerprint as Parquet; an existing store is not overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    facts.write.mode("errorifexists").parquet(f"{path}/facts")


def load_if(spark: SparkSession, facts: DataFrame, path: str) -> DataFrame | None:
    """Stored rows if their fingerprint equals ``facts`` in every column, else None."""
    try:
        stored = spark.read.parquet(f"{path}/facts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if stored.columns != facts.columns or not stored.exceptAll(facts).isEmpty() or not facts.exceptAll(stored).isEmpty():
        return None
    return spark.read.parquet(f"{path}/rows")


def valid_name(name: Column) -> Column:
    """Not empty, no control characters, none of the characters that paths give a meaning."""
    return F.coalesce((F.length(F.trim(name)) > 0) & ~name.rlike(r"[\x00-\x1F\x7F\\/:*?\"<>|]"), F.lit(False))


def same_iso(a: Column, b: Column) -> Column:
    return g.same_float(a, b, TOLERANCE)


def save_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def load_flips(spark: SparkSession, path: str) -> DataFrame:
    """Flip points; any bad row rejects the file. Rows of the older kind ``seed`` are kept but not accepted."""
    rows = spark.read.schema(FLIP).option("mode", "FAILFAST").json(path)
    return rows.withColumn("accepted", F.coalesce("accepted", F.lit(True)) & (F.coalesce("kind", F.lit("")) != "seed"))


def load_strokes(lines: DataFrame, column: str = "value") -> DataFrame:
    """(stroke_id, schema, n_points, fit, ms, anchors, leaves, centerline, samples, triangles, valid) from stroke log lines.

    A fit is a tuple of 14 (version 1) or 16 numbers (version 2); the last four are counts of leaves, centreline nodes,
    samples and triangles. A stroke with tuples of another width, or whose anchor counts fall, is not valid.
    """
    s = lines.select(F.from_json(column, STROKE).alias("s")).select("s.*")
    width = F.when(F.col("schema") == 1, FIT_WIDTHS[1]).when(F.col("schema") == 2, FIT_WIDTHS[2])
    fine = F.coalesce(F.forall("points", lambda p: F.size(p) == 4) & F.forall("fits", lambda f: F.size(f) == width), F.lit(False))
    rising = F.aggregate("fits", F.struct(F.lit(0.0).alias("last"), F.lit(True).alias("ok")), lambda acc, f: F.struct(F.coalesce(F.get(f, F.lit(1)), acc.last).alias("last"), (acc.ok & (F.coalesce(F.get(f, F.lit(1)), acc.last) >= acc.last)).alias("ok")), lambda acc: acc.ok)
    each = s.select("stroke_id", "schema", F.size("points").alias("n_points"), (fine & F.coalesce(rising, F.lit(False))).alias("valid"), F.posexplode_outer("fits").alias("fit", "f"))
    tail = lambda n: F.element_at("f", n).cast("long")
    return each.select("stroke_id", "schema", "n_points", "fit", F.get("f", F.lit(0)).alias("ms"), F.get("f", F.lit(1)).cast("long").alias("anchors"), *[F.when(F.size("f") >= 4, F.try_element_at("f", F.lit(-4 + i)).cast("long")).alias(n) for i, n in enumerate(("leaves", "centerline", "samples", "triangles"))], "valid")


def presets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Brush presets from JSON: absent numbers get their default, then all are clamped."""
    parsed = [F.coalesce(F.get_json_object(column, f"$.{n}").try_cast("double"), F.lit(d)) for n, d, _, _ in PRESET]
    return lines.select(F.coalesce(F.get_json_object(column, "$.name"), F.lit("preset")).alias("name"), *[g.clamp(c, lo, hi).alias(n) for c, (n, _, lo, hi) in zip(parsed, PRESET, strict=True)])


def catalog(lines: DataFrame, base: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(entries (label, path, is_default), counts (blank, invalid, kept)) of catalogue lines; relative paths start at ``base``."""
    s = lines.select(F.trim(F.col(column)).alias("line"), F.from_json(F.trim(F.col(column)), 'label string, path string, `default` boolean').alias("s"))
    blank, good = F.col("line") == "", F.col("s.path").isNotNull() & (F.trim(F.col("s.path")) != "")
    path = F.when(F.col("s.path").rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), F.col("s.path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.col("s.path")))
    entries = s.where(~blank & good).select(F.coalesce("s.label", F.regexp_extract("s.path", r"([^/\\]*?)(\.[^./\\]*)?$", 1)).alias("label"), path.alias("path"), F.coalesce("s.default", F.lit(False)).alias("is_default"))
    return entries, s.agg(F.count_if(blank).alias("blank"), F.count_if(~blank & ~F.coalesce(good, F.lit(False))).alias("invalid"), F.count_if(~blank & F.coalesce(good, F.lit(False))).alias("kept"))


def pick_report(source: DataFrame, pick: DataFrame, surface: DataFrame, nearest: DataFrame) -> DataFrame:
    """(stage, record): four one-row tables as JSON lines, world lengths also in millimetres."""
    out = None
    for n, (stage, rows) in enumerate((("source", source), ("pick", pick), ("surface", surface), ("target", nearest))):
        mm = [(F.col(c) * 1000.0).alias(f"{c}_mm") for c in rows.columns if c in ("wx", "wy", "wz")]
        line = rows.select(F.lit(n).alias("order"), F.lit(stage).alias("stage"), F.to_json(F.struct("*", *mm)).alias("record"))
        out = line if out is None else out.unionByName(line)
    return out
