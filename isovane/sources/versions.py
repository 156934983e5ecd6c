"""Stores that commit: rows lie in a folder of their own, and one small manifest, renamed into place, makes them the store's.

A writer that dies leaves rows that no manifest names, and the store as it was. Readers compare everything that the rows
were made from and refuse on any difference.
"""

from __future__ import annotations

import json
import math
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isovane.sources.stores import TOLERANCE, fingerprint
from isovane.sources.voxels import Grid

#: Layout of manifests; readers refuse any other.
SCHEMA = 1
#: Facts that are compared within TOLERANCE, relative to the larger; all others must be equal.
CLOSE = ("iso",)
#: Most kinds of rows that a manifest counts.
MOST_KINDS = 1_000
SUFFIX = ".weights"


class Refused(ValueError):
    """A store that is not what the reader or writer needs, with the reason."""


def grid_facts(grid: Grid, source: str, **settings) -> dict:
    """What rows made from a grid depend on: source, name, class, transform, counts, bounds and content of its voxels, settings."""
    found = fingerprint(grid, {}).drop("settings").first().asDict()
    place = {"background": grid.background, "spacing": list(grid.spacing), "origin": list(grid.origin)}
    return {"source": source, **found, **place, **settings}


def difference(stored: dict, expected: dict) -> str | None:
    """The first fact, by name, that only one side has or that differs; None if all agree."""
    for key in sorted({*stored, *expected}):
        if key not in stored or key not in expected:
            return f"{key} is only in the {'expected' if key in expected else 'stored'} facts"
        a, b = stored[key], expected[key]
        near = key in CLOSE and all(isinstance(x, (int, float)) for x in (a, b)) and math.isclose(a, b, rel_tol=TOLERANCE, abs_tol=TOLERANCE)
        if a != b and not near:
            return f"{key} is {a!r} in the store and {b!r} here"
    return None


class Store:
    """Rows of one kind in versions: ``rows/<id>`` holds Parquet files, ``manifest/v<n>.json`` names those of version n.

    ``by`` names a column whose values are counted at saving and compared at loading.
    The rename of the manifest fails if that version is there, so of two writers one is refused. That needs a file
    system whose rename is atomic; on others it is a check, not a lock.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str, by: str | None = None) -> None:
        self.spark, self.kind, self.by = spark, kind, by
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self._path(path)).toString()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:08d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def latest(self) -> int:
        """The newest version, 0 where nothing was ever committed."""
        return max(self.versions(), default=0)

    def _tally(self, rows: DataFrame) -> dict[str, int]:
        if self.by is None:
            return {"": rows.count()}
        counts = rows.groupBy(F.coalesce(F.col(self.by).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n")).limit(MOST_KINDS + 1).collect()
        if len(counts) > MOST_KINDS:
            raise Refused(f"{self.by} has more than {MOST_KINDS} values")
        return {r.k: r.n for r in counts}

    def save(self, rows: DataFrame, facts: dict, after: int = 0) -> int:
        """Commit ``rows`` as the version that follows ``after`` and return its number.

        A store that has a newer version than ``after`` (by default: any) is refused: load it before replacing it.
        """
        if self.latest() != after:
            raise Refused(f"the store has version {self.latest()}, not {after}; load it before overwriting")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{name}")
        manifest = {"schema": SCHEMA, "kind": self.kind, "version": after + 1, "rows": name, "columns": json.loads(written.schema.json()), "facts": facts, "tally": self._tally(written)}
        self._commit(after + 1, json.dumps(manifest, sort_keys=True, allow_nan=False))
        return after + 1

    def _commit(self, version: int, text: str) -> None:
        """Write beside, then rename without overwriting."""
        beside, target = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}"), self._path(self._manifest(version))
        self.fs.mkdirs(beside.getParent())
        out = self.fs.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(beside, target, plain)
        except Exception as e:
            self.fs.delete(beside, False)
            if self.fs.exists(target):
                raise Refused(f"another writer committed version {version}") from e
            raise

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest by default; one that is absent, broken or of another layout or kind is refused."""
        wanted = self.latest() if version is None else version
        if wanted not in self.versions():
            raise Refused("the store has no such version" if version else "there is no store")
        try:
            found = json.loads(self.spark.read.text(self._manifest(wanted), wholetext=True).first()[0])
        except (ValueError, TypeError) as e:
            raise Refused("the manifest can't be read") from e
        if not isinstance(found, dict) or found.get("schema") != SCHEMA or not {"kind", "rows", "columns", "facts", "tally"} <= set(found):
            raise Refused("the manifest is incomplete or of another layout")
        if found["kind"] != self.kind:
            raise Refused(f"the store holds {found['kind']}, not {self.kind}")
        return found

    def load(self, facts: dict, version: int | None = None) -> DataFrame:
        """The rows of a version if its facts agree with ``facts`` and the rows are those that were counted at saving."""
        found = self.manifest(version)
        apart = difference(found["facts"], json.loads(json.dumps(facts)))
        if apart:
            raise Refused(apart)
        rows = self.spark.read.schema(T.StructType.fromJson(found["columns"])).parquet(f"{self.path}/rows/{found['rows']}")
        tally = self._tally(rows)
        if tally != found["tally"]:
            raise Refused(f"counts are {tally}, {found['tally']} were saved")
        return rows

    def load_or(self, facts: dict, make) -> DataFrame:
        """Rows from the store; where it refuses, those that ``make()`` gives, committed as the next version."""
        try:
            return self.load(facts)
        except Refused:
            self.save(make(), facts, self.latest())
            return self.load(facts)

    def vacuum(self, older_than_s: float) -> int:
        """Delete row folders that no manifest names and that are older than any running writer; returns how many."""
        named = {self.manifest(n)["rows"] for n in self.versions()}
        folder, now, gone = self._path(f"{self.path}/rows"), self.jvm.java.lang.System.currentTimeMillis(), 0
        for s in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if s.getPath().getName() not in named and now - s.getModificationTime() > older_than_s * 1000:
                gone += bool(self.fs.delete(s.getPath(), True))
        return gone


def _library_store(spark: SparkSession, library: str, name: str) -> Store:
    if not name.strip() or name in (".", "..") or re.search(r"[\x00-\x1F\x7F\\/:*?\"<>|]", name):
        raise Refused('names of weight fields are not empty and have none of \\ / : * ? " < > |')
    return Store(spark, f"{library}/{name}{SUFFIX}", "surface_weight")


def save_weights(library: str, name: str, weights: DataFrame, grid: Grid, source: str, after: int = 0) -> int:
    """Commit a weight field (x, y, z, weight) of ``grid`` to a library; a name that is taken is refused unless ``after`` is its version."""
    return _library_store(weights.sparkSession, library, name).save(weights.select("x", "y", "z", "weight"), _weight_facts(grid, source), after)


def load_weights(spark: SparkSession, library: str, name: str, grid: Grid, source: str) -> DataFrame:
    """The weight field of that name, refused unless it was made for the same source, grid name, bounds and transform."""
    return _library_store(spark, library, name).load(_weight_facts(grid, source))


def _weight_facts(grid: Grid, source: str) -> dict:
    """Values may change under a weight field, bounds of active voxels and transform may not."""
    keep = ("source", "grid", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z", "spacing", "origin")
    return {k: v for k, v in grid_facts(grid, source).items() if k in keep}


def list_weights(spark: SparkSession, library: str) -> DataFrame:
    """(name, version, rows, source, saved_at) of each field in a library, by name: its manifests are listed as a table of files."""
    shape = "name string, version int, rows long, source string, saved_at timestamp"
    try:
        files = spark.read.format("binaryFile").load(f"{library}/*{SUFFIX}/manifest/v*.json")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)
    parsed = F.from_json(F.decode("content", "UTF-8"), "version int, kind string, facts struct<source: string>, tally map<string, long>")
    name = F.regexp_extract("path", rf"([^/]+){re.escape(SUFFIX)}/manifest/[^/]+$", 1)
    each = files.select(name.alias("name"), "modificationTime", parsed.alias("m")).where("m.kind = 'surface_weight'")
    total = F.aggregate(F.map_values("m.tally"), F.lit(0).cast("long"), lambda a, b: a + b)
    facts = F.struct("m.version", total.alias("rows"), F.col("m.facts.source").alias("source"), F.col("modificationTime").alias("saved_at"))
    return each.groupBy("name").agg(F.max(facts).alias("s")).select("name", "s.*").orderBy("name")
