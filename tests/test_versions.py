"""Stores that commit whole versions or nothing, and files beside a grid that are refused for one difference."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from isovane.operators import target
from isovane.sources import sidecars, stores, versions
from isovane.sources import voxels as v
from isovane.sources.versions import Refused, Store

SPACING = (0.31, 0.31, 1.0)


def layered(spark, side: int = 2, depth: int = 2, **kwargs) -> v.Grid:
    rows = [(x, y, z, 255.0 if x <= 0 else {1: 128.0, 2: 64.0}[x]) for y in range(-side, side + 1) for z in range(-side, side + 1) for x in range(-depth, 3)]
    return v.from_rows(spark, rows, **({"spacing": SPACING} | kwargs))


def test_samples_come_back_only_for_the_same_grid_and_settings(spark, tmp_path):
    grid = layered(spark)
    facts = versions.grid_facts(grid, "a.vdb", iso=255.0, layers=2)
    store = Store(spark, str(tmp_path / "s"), "samples", by="kind")
    samples = target.classified(grid, target.TargetSettings())
    assert store.latest() == 0
    with pytest.raises(Refused, match="no store"):
        store.load(facts)
    assert store.save(samples, facts) == 1
    back = store.load(facts)
    assert back.count() == 116 and back.exceptAll(samples).isEmpty() and store.manifest()["tally"] == {"core": 66, "transition": 50}
    assert store.load(facts | {"iso": 255.0 * (1 + 5e-7)}).count() == 116
    for change in ({"iso": 254.0}, {"source": "b.vdb"}, {"layers": 3}, {"spacing": [1.0, 1.0, 1.0]}, {"max_x": 9}, {"more": 1}):
        with pytest.raises(Refused):
            store.load(facts | change)
    assert Store(spark, str(tmp_path / "s"), "samples", by="kind").load(versions.grid_facts(layered(spark), "a.vdb", iso=255.0, layers=2)).count() == 116
    with pytest.raises(Refused, match="holds samples"):
        Store(spark, str(tmp_path / "s"), "normals").load(facts)


def test_overwriting_needs_the_version_that_was_read(spark, tmp_path):
    store, rows = Store(spark, str(tmp_path / "s"), "numbers"), spark.range(5)
    assert store.save(rows, {"a": 1}) == 1
    for after in (0, 2):
        with pytest.raises(Refused, match="load it before"):
            store.save(rows, {"a": 2}, after)
    assert store.save(spark.range(7), {"a": 2}, after=1) == 2
    assert store.load({"a": 2}).count() == 7 and store.load({"a": 1}, version=1).count() == 5
    with pytest.raises(Refused, match="another writer"):
        store._commit(2, "{}")
    assert store.versions() == [1, 2] and store.load({"a": 2}).count() == 7


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "numbers")
    store.save(spark.range(5), {"a": 1})
    dying = spark.range(0, 1000, 1, 8).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        store.save(dying, {"a": 2}, after=1)
    assert store.latest() == 1 and sorted(r.id for r in store.load({"a": 1}).collect()) == [0, 1, 2, 3, 4]
    spark.range(3).write.parquet(str(tmp_path / "s/rows/left"))
    assert store.vacuum(3600) == 0 and store.vacuum(-1) >= 1 and store.load({"a": 1}).count() == 5


def test_lost_rows_and_broken_manifests_are_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), "numbers")
    store.save(spark.range(0, 50, 1, 5), {"a": 1})
    files = sorted((tmp_path / "s/rows").glob("*/part-*.parquet"))
    files[0].rename(tmp_path / "away")
    with pytest.raises(Refused, match="were saved"):
        store.load({"a": 1})
    (tmp_path / "away").rename(files[0])
    manifest = tmp_path / "s/manifest/v00000001.json"
    whole = json.loads(manifest.read_text())
    for text in ("{broken", json.dumps(whole | {"schema": 2}), json.dumps({k: x for k, x in whole.items() if k != "tally"}), "[]"):
        (tmp_path / "s/manifest/.v00000001.json.crc").unlink(missing_ok=True)
        manifest.write_text(text)
        with pytest.raises(Refused):
            store.load({"a": 1})
    made = []
    got = store.load_or({"a": 1}, lambda: made.append(1) or spark.range(4))
    assert got.count() == 4 and store.load_or({"a": 1}, lambda: made.append(1)).count() == 4 and made == [1]


def test_weight_fields_of_a_library(spark, tmp_path):
    grid, library = layered(spark), str(tmp_path / "lib")
    weights = spark.createDataFrame([(0, 0, 0, 0.5), (1, 0, 0, 1.0)], "x int, y int, z int, weight double")
    assert versions.list_weights(spark, library).count() == 0
    assert versions.save_weights(library, "b + 5%", weights, grid, "a.vdb") == 1
    versions.save_weights(library, "a", weights.limit(1), grid, "a.vdb")
    with pytest.raises(Refused, match="load it"):
        versions.save_weights(library, "a", weights, grid, "a.vdb")
    assert versions.save_weights(library, "a", weights, grid, "a.vdb", after=1) == 2
    assert [(r.name, r.version, r.rows, r.source) for r in versions.list_weights(spark, library).collect()] == [("a", 2, 2, "a.vdb"), ("b + 5%", 1, 2, "a.vdb")]
    assert versions.load_weights(spark, library, "b + 5%", grid, "a.vdb").count() == 2
    brighter = grid.of(grid.voxels.withColumn("value", F.col("value") + 1))
    assert versions.load_weights(spark, library, "a", brighter, "a.vdb").count() == 2
    for other, source in ((grid, "b.vdb"), (layered(spark, 3), "a.vdb"), (layered(spark, spacing=(1.0, 1.0, 1.0)), "a.vdb"), (layered(spark, name="other"), "a.vdb")):
        with pytest.raises(Refused):
            versions.load_weights(spark, library, "a", other, source)
    for bad in ("", "  ", "..", "a/b", "a?", "a\n"):
        with pytest.raises(Refused, match="names"):
            versions.save_weights(library, bad, weights, grid, "a.vdb")


def test_seeds(spark, tmp_path):
    row = spark.createDataFrame([(1, 2, 3, [0.1, 0.2, 0.3], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0])], "x int, y int, z int, world array<double>, normal array<double>, ray_direction array<double>")
    line = sidecars.seed_lines(row, "a.vdb", "density", 255.0).first()[0]
    path = tmp_path / "seed.jsonl"
    path.write_text(line + "\n")
    load = lambda *a: sidecars.load_seed(spark, str(path), *a)
    got = load("a.vdb", "density", 255.0 * (1 + 5e-7)).first()
    assert (got.x, got.y, got.z, got.world, got.normal, got.ray_direction) == (1, 2, 3, [0.1, 0.2, 0.3], [0.0, 0.0, 1.0], [0.0, 1.0, 0.0])
    assert sidecars.load_seed(spark, str(tmp_path / "none"), "a.vdb", "density", 255.0) is None
    for a in (("b.vdb", "density", 255.0), ("a.vdb", "other", 255.0), ("a.vdb", "density", 254.0)):
        with pytest.raises(Refused, match="foreign"):
            load(*a)
    seed = json.loads(line)
    cases = {"incomplete": ["{broken", {"schema": 2}, {"valid": False}, {"world": None}, {"normal": [0.0, 1.0]}, {"coordinate": [1, None, 2]}, {"iso": None}], "vectors": [{"normal": [0.0, 0.0, 0.0]}, {"world": [0.0, None, 1.0]}]}
    texts = [(k, c if isinstance(c, str) else json.dumps(seed | c)) for k, cs in cases.items() for c in cs] + [(None, line), ("incomplete", ""), ("incomplete", None)]
    out = sidecars.seeds(spark.createDataFrame(texts, "want string, value string"), "a.vdb", "density", 255.0).collect()
    assert [(r.want, r.refusal) for r in out] == [(k, k) for k, _ in texts]


def test_flip_files(spark, tmp_path):
    facts = {"source": "a.vdb", "grid": "density", "source_file_size": 1234, "source_write_time": 5678, "iso": 255.0, "transition_layers": 2}
    head = {"schema": 1, "kind": "metadata"} | facts
    flip = lambda *at, sign=1, **more: {"schema": 1, "kind": "flip_point", "coordinate": list(at), "target_sign": sign, "color": [1, 2, 3, 4], "accepted": 1} | more
    rows = [flip(1, 2, 3), flip(-4, 5, -6, sign=0, accepted=0), flip(7, 8, 9, kind="seed", color=None)]
    path = tmp_path / "flips.jsonl"

    def load(lines, **other):
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        return sidecars.load_flip_file(spark, str(path), facts | other)

    got = load([head, *rows[:1], "", *rows[1:]]).orderBy("place").collect()
    assert [(r.x, r.y, r.z, r.target_sign, r.active, r.accepted) for r in got] == [(1, 2, 3, 1, True, True), (-4, 5, -6, 0, True, False), (7, 8, 9, 1, False, True)]
    assert [r.color for r in got] == [[1, 2, 3, 4], [1, 2, 3, 4], [255] * 4]
    assert sidecars.load_flip_file(spark, str(tmp_path / "none"), facts) is None and load([head]).count() == 0
    for other in ({"iso": 254.0}, {"source": "b"}, {"source_file_size": 1}, {"source_write_time": 1}, {"transition_layers": 3}):
        with pytest.raises(Refused, match="another"):
            load([head, *rows], **other)
    for first in ([], [flip(1, 2, 3)], ["{broken"], [head | {"schema": 2}], [head | {"iso": None}]):
        with pytest.raises(Refused, match="header"):
            load([*first, *rows])
    for bad in ("{broken", head, flip(1, 2), flip(1, 2, 3, sign=256), flip(1, 2, 3, sign=-1), flip(1, 2, 3, kind="other"), flip(1, 2, 3, schema=2), flip(1, 2, 3, accepted=2)):
        with pytest.raises(Refused, match="not valid"):
            load([head, *rows, bad])


def test_stroke_logs_grow_by_whole_strokes(spark, tmp_path):
    shape, path = "schema int, stroke_id string, points array<array<double>>, fits array<array<double>>", str(tmp_path / "log")
    stroke = lambda n, schema, width: spark.createDataFrame([(schema, n, [[0.0] * 4], [[1.0] * width])], shape)
    sidecars.append_strokes(stroke("a", 2, 16), path)
    sidecars.append_strokes(stroke("b", 1, 14), path)
    for bad in (stroke("c", 2, 14), stroke("c", 3, 16)):
        with pytest.raises(Refused, match="width"):
            sidecars.append_strokes(bad.union(stroke("d", 2, 16)), path)
    assert {(r.stroke_id, r.valid) for r in stores.load_strokes(spark.read.text(path)).collect()} == {("a", True), ("b", True)}


def test_catalogues_drop_and_count_missing_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.vdb", "b c.vdb"):
        (tmp_path / "in" / name).write_bytes(b"12345")
    lines = spark.createDataFrame([(json.dumps({"path": p}),) for p in ("in/a.vdb", "./in/b c.vdb", "in/none.vdb", str(tmp_path / "in/a.vdb"))], "value string")
    entries, _ = stores.catalog(lines, str(tmp_path))
    kept, counts = sidecars.present(entries, sidecars.listed(spark, str(tmp_path), "*.vdb"))
    assert sorted((r.label, r.length) for r in kept.collect()) == [("a", 5), ("a", 5), ("b c", 5)] and tuple(counts.first()) == (3, 1)


def test_strokes_are_replayed_on_their_own_surface(spark):
    shape = "stroke_id string, grid_name string, iso double, adaptivity double, fits array<array<double>>"
    fits = lambda *anchors: [[0.0, float(a), 0.0] for a in anchors]
    fine = [("a", "density", 255.0, 0.0, fits(1, 2, 2)), ("b", "density", 255.00005, 0.0, []), ("c", "density", 255.0, 0.0, fits(4))]
    assert sidecars.replayable(spark.createDataFrame(fine, shape), "density", 255.0).count() == 3
    assert sidecars.replayable(spark.createDataFrame([], shape), "density", 255.0).count() == 0
    for bad, why in ((("d", "other", 255.0, 0.0, []), "surface"), (("d", "density", 254.0, 0.0, []), "surface"), (("d", "density", 255.0, 0.5, []), "surface"), (("d", "density", None, 0.0, []), "surface"), (("d", "density", 255.0, 0.0, fits(3, 1)), "anchor"), (("d", "density", 255.0, 0.0, None), "anchor")):
        with pytest.raises(Refused, match=why):
            sidecars.replayable(spark.createDataFrame([*fine, bad], shape), "density", 255.0)
