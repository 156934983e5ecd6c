"""Small files beside a grid: orientation seeds, flip points, stroke logs and catalogues, checked line by line as columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isovane.sources.stores import FIT_WIDTHS, same_iso
from isovane.sources.versions import Refused

#: Layout of seed and flip lines.
SCHEMA = 1
SEED = "schema int, source string, grid string, iso double, valid boolean, coordinate array<int>, world array<double>, normal array<double>, ray_direction array<double>"
HEAD = "schema double, kind string, source string, grid string, source_file_size long, source_write_time long, iso double, transition_layers long"
FLIP = "schema double, kind string, coordinate array<int>, target_sign long, color array<long>, accepted string"
#: Most that iso and adaptivity of a replayed stroke may differ.
REPLAY = 1e-4
WHITE = [255, 255, 255, 255]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _triple(c: Column, real: bool = True) -> Column:
    return F.coalesce((F.size(c) == 3) & F.forall(c, lambda v: _finite(v) if real else v.isNotNull()), F.lit(False))


def seeds(lines: DataFrame, source: str, grid: str, iso: Column | float, column: str = "value") -> DataFrame:
    """Every row of ``lines`` with (x, y, z, world, normal, ray_direction) of its seed and ``refusal``, null where the seed counts.

    Refusals, the first that holds: ``incomplete`` (bad JSON, an absent part, another layout, not marked valid), ``foreign``
    (another source, grid or iso value), ``vectors`` (a part that is not finite, a normal of no length).
    """
    s = lines.withColumn("_s", F.from_json(column, SEED))
    f = lambda n: F.col(f"_s.{n}")
    wanted = iso if isinstance(iso, Column) else F.lit(float(iso))
    whole = (f("schema") == SCHEMA) & f("valid") & f("source").isNotNull() & f("grid").isNotNull() & f("iso").isNotNull()
    for n in ("coordinate", "world", "normal", "ray_direction"):
        whole &= F.size(f(n)) == 3
    whole &= F.forall(f("coordinate"), lambda v: v.isNotNull())
    ours = (f("source") == source) & (f("grid") == grid) & same_iso(f("iso"), wanted) & _finite(f("iso"))
    squared = F.aggregate(f("normal"), F.lit(0.0), lambda a, v: a + v * v)
    fine = _triple(f("world")) & _triple(f("normal")) & _triple(f("ray_direction")) & (squared > 1e-20)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    refusal = F.when(no(whole), "incomplete").when(no(ours), "foreign").when(no(fine), "vectors")
    at = [F.get(f("coordinate"), F.lit(i)).alias(k) for i, k in enumerate("xyz")]
    return s.select(*lines.columns, *at, *[f(n).alias(n) for n in ("world", "normal", "ray_direction")], refusal.alias("refusal"))


def seed_lines(rows: DataFrame, source: str, grid: str, iso: float) -> DataFrame:
    """(value): a JSON line for each row (x, y, z, world, normal, ray_direction), as ``seeds`` reads it."""
    head = [F.lit(SCHEMA).alias("schema"), F.lit(source).alias("source"), F.lit(grid).alias("grid"), F.lit(float(iso)).alias("iso"), F.lit(True).alias("valid")]
    return rows.select(F.to_json(F.struct(*head, F.array("x", "y", "z").alias("coordinate"), "world", "normal", "ray_direction")).alias("value"))


def load_seed(spark: SparkSession, path: str, source: str, grid: str, iso: float) -> DataFrame | None:
    """The one seed in a file, None where there is no file; a seed that doesn't count raises with its refusal."""
    lines = _text(spark, path)
    if lines is None:
        return None
    found = seeds(lines.where(F.trim("value") != ""), source, grid, iso)
    first = found.select("refusal").head(2)
    if len(first) != 1:
        raise Refused("a seed file holds one seed")
    if first[0].refusal:
        raise Refused(f"the seed is {first[0].refusal}")
    return found.drop("value", "refusal")


def _text(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def flips(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every row of ``lines`` with (x, y, z, target_sign, active, color, accepted) of its flip point and ``valid``.

    Kind ``flip_point`` is active, the older ``seed`` is kept but not active. Absent colours are white, absent acceptance is
    true. Valid: this layout, one of the two kinds, three whole coordinates, a sign of 0 to 255, acceptance 0 or 1.
    """
    s = lines.withColumn("_f", F.from_json(column, FLIP))
    f = lambda n: F.col(f"_f.{n}")
    agreed = F.coalesce(f("accepted"), F.lit("1"))
    valid = (f("schema") == SCHEMA) & f("kind").isin("flip_point", "seed") & _triple(f("coordinate"), False) & f("target_sign").between(0, 255) & agreed.isin("0", "1", "true", "false")
    full = F.coalesce((F.size(f("color")) == 4) & F.forall(f("color"), lambda v: v.isNotNull() & v.between(0, 255)), F.lit(False))
    color = F.when(full, f("color")).otherwise(F.array(*[F.lit(c).cast("long") for c in WHITE]))
    at = [F.get(f("coordinate"), F.lit(i)).alias(k) for i, k in enumerate("xyz")]
    return s.select(*lines.columns, *at, f("target_sign").cast("short").alias("target_sign"), (f("kind") == "flip_point").alias("active"), color.alias("color"), agreed.isin("1", "true").alias("accepted"), F.coalesce(valid, F.lit(False)).alias("valid"))


def load_flip_file(spark: SparkSession, path: str, facts: dict) -> DataFrame | None:
    """(place, x, y, z, target_sign, active, color, accepted) of one file of flip points, ``place`` rising as its lines do.

    ``facts``: source, grid, source_file_size, source_write_time, iso and transition_layers that the first line must have.
    None where there is no file. Another first line or any bad row refuses all.
    """
    lines = _text(spark, path)
    if lines is None:
        return None
    placed = lines.withColumn("place", F.monotonically_increasing_id())
    head = placed.withColumn("h", F.from_json("value", HEAD)).select("place", "h.*").first()
    keys = ("source", "grid", "source_file_size", "source_write_time", "iso", "transition_layers")
    if head is None or head.kind != "metadata" or head.schema != SCHEMA or any(head[k] is None for k in keys):
        raise Refused("the first line is not a whole header")
    near = abs(head.iso - facts["iso"]) <= 1e-6 * max(1.0, abs(head.iso), abs(facts["iso"]))
    if not near or any(head[k] != facts[k] for k in keys if k != "iso"):
        raise Refused("the flip points belong to another surface target")
    rows = flips(placed.where((F.col("place") > head.place) & (F.col("value") != "")))
    bad = rows.where("NOT valid").select("place").head(1)
    if bad:
        raise Refused("a flip point is not valid")
    return rows.drop("value", "valid")


def append_strokes(strokes: DataFrame, path: str) -> None:
    """Append strokes (schema, stroke_id, points, fits) to a log of JSON lines; one with a tuple of a wrong width refuses all."""
    width = F.when(F.col("schema") == 1, FIT_WIDTHS[1]).when(F.col("schema") == 2, FIT_WIDTHS[2])
    fine = F.forall("points", lambda p: F.size(p) == 4) & F.forall("fits", lambda f: F.size(f) == width)
    if strokes.where(~F.coalesce(fine, F.lit(False))).head(1):
        raise Refused("a stroke has a tuple of a wrong width")
    strokes.select("schema", "stroke_id", "points", "fits").write.mode("append").json(path)


def replayable(strokes: DataFrame, grid: str, iso: float, adaptivity: float = 0.0) -> DataFrame:
    """``strokes`` (grid_name, iso, adaptivity, fits and others), refused whole if one was recorded on another surface.

    Both numbers may differ by ``REPLAY`` at most; an absent one, another grid, or anchor counts (second in a fit) that fall refuse.
    """
    near = lambda c, wanted: _finite(F.col(c)) & (F.abs(F.col(c) - wanted) <= REPLAY)
    same = (F.col("grid_name") == grid) & near("iso", float(iso)) & near("adaptivity", float(adaptivity))
    anchors = F.transform("fits", lambda f: F.get(f, F.lit(1)))
    rising = F.forall(F.zip_with(anchors, F.slice(anchors, 2, F.greatest(F.size("fits"), F.lit(1))), lambda a, b: b.isNull() | (a <= b)), lambda ok: ok)
    bad = strokes.select(F.when(~F.coalesce(same, F.lit(False)), "another surface").when(~F.coalesce(rising, F.lit(False)), "falling anchor counts").alias("why")).where("why IS NOT NULL").head(1)
    if bad:
        raise Refused(f"a stroke can't be replayed: {bad[0].why}")
    return strokes


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files under ``folder``; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(_plain("path").alias("path"), "length", F.col("modificationTime").alias("modified"))


def _plain(path: str) -> Column:
    """Without the scheme of local files, and without empty or ``.`` steps."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(path), "^file:/*", "/"), r"/(\./)+", "/"), "(?<!:)/{2,}", "/")


def present(entries: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of a catalogue whose file is listed, with its length; one row (kept, missing) of counts)."""
    there = files.groupBy(F.col("path").alias("_path")).agg(F.max("length").alias("length"))
    joined = entries.withColumn("_key", _plain("path")).join(there, F.col("_key") == F.col("_path"), "left")
    counts = joined.agg(F.count("_path").alias("kept"), (F.count("*") - F.count("_path")).alias("missing"))
    return joined.where(F.col("_path").isNotNull()).drop("_key", "_path"), counts
