"""Streams give what one batch gives, and replays change nothing."""

from __future__ import annotations

from isovane.operators import strokes
from isovane.sources.voxels import table
from isovane.streaming import strokes as live

SF = "/root/testdata/sf0.001"


def test_spacing_over_batches(spark, tmp_path):
    points = strokes.stroke_events(table(spark, SF, "events")).select("stroke_id", "seq", "wx", "wy", "wz").where("stroke_id < 20").cache()
    last = points.agg({"seq": "max"}).first()[0]
    for i, (lo, hi) in enumerate(((0, last // 2), (last // 2, last))):
        points.where(f"seq > {lo} AND seq <= {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
        query = live.refit_every(live.spaced_stream(stream, 20.0), lambda df, n, i=i: df.write.parquet(str(tmp_path / f"out/run={i}/batch={n}")), str(tmp_path / "check"), None)
        assert query.awaitTermination(120)
    got = {(r.stroke_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.stroke_id, r.seq) for r in strokes.spaced(points, 20.0).collect()}


def test_replayed_merges(spark, tmp_path):
    a = spark.createDataFrame([(0, 0, 0, 0.5), (1, 0, 0, 0.7), (2, 0, 0, -1.0)], "x int, y int, z int, weight double")
    b = spark.createDataFrame([(0, 0, 0, 0.9), (1, 0, 0, float("nan"))], a.schema)
    field = live.WeightField(str(tmp_path / "field"))
    for batch, df in ((0, a), (1, b), (0, a)):
        field.merge(df, batch)
    assert {(r.x, r.weight) for r in field.read(spark).collect()} == {(0, 0.9), (1, 0.7)}


def test_windows(spark, tmp_path):
    events = table(spark, SF, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = live.per_minute(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_tails(spark):
    points = spark.createDataFrame([(1, i, 0.0, 0.0, 0.0) for i in range(1, 6)], "stroke_id long, seq int, wx double, wy double, wz double")
    fitted = spark.createDataFrame([(1, 3)], "stroke_id long, n_fitted int")
    assert sorted(r.seq for r in live.tails(points, fitted).collect()) == [3, 4, 5]
