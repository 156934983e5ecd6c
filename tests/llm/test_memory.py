"""What a task of the text operators holds at a time."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isovane.llm import language
from isovane.llm.arrowtext import in_pieces

SF = "/root/testdata/sf0.001"


def prose(rows: int, words: int) -> list[str]:
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñ") for _ in range(rng.randrange(2, 10))) for _ in range(5_000)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(rows)]


@pytest.mark.parametrize("grouped", [False, True])
def test_language_profiles_take_little_memory_besides_the_texts(grouped):
    column = pa.array(prose(1_200, 500))
    assert column.nbytes > 6 * language.PIECE
    group = (np.arange(len(column)) % 4, 4) if grouped else ()
    language._lower_table()
    tracemalloc.start()
    for _ in language._bundles(column, 3, 1024, *group):
        pass
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 40e6


@pytest.mark.parametrize(("block", "counts"), [(1, 0), (7, 0), (100, 1 << 30), (1 << 20, 0)])
def test_profiles_are_the_same_in_any_blocks(monkeypatch, block, counts):
    column = pa.array([*prose(30, 40), None, "", "...", "Ein Wort"])
    group = np.arange(len(column)) % 3
    found = []
    for b, c in ((1 << 14, 1 << 20), (block, counts)):
        monkeypatch.setattr(language, "BLOCK", b)
        monkeypatch.setattr(language, "COUNTS", c)
        found.append([np.concatenate([v for _, _, v, _ in language._bundles(column, 3, 128, *more)]) for more in ((), (group, 3))])
    assert all(np.array_equal(x, y) for x, y in zip(*found, strict=True))


def test_language_stage_sends_each_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = language.keep_identified(docs)._jdf.queryExecution().analyzed().toString()
    sent = next(line for line in plan.splitlines()[::-1] if "Project" in line)  # what the lowest projection hands on
    assert "_body" not in plan and sent.count("text#") <= 2  # text AS _1, no copy beside it


def test_language_stage_keeps_rows_as_they_are(spark):
    """Columns with names of predictions, repeated rows and nulls come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(7), "lang_pred": F.col("doc_id") % 5, "_1": F.array("source"), "a.b": F.lit(None).cast("int")})
    twice = docs.unionByName(docs)
    kept = language.keep_identified(twice)
    assert kept.dtypes == docs.dtypes
    assert kept.count() >= 0.9 * twice.count() and kept.exceptAll(twice).count() == 0
    names = [f"c{i}" for i in range(len(docs.columns))]
    assert kept.toDF(*names).groupBy(*names).count().where("count % 2 = 1").count() == 0


def test_batches_in_pieces_are_whole():
    texts = [None, "", "x" * 3_000_000, *prose(1_500, 200), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t if t is None else t.encode() for t in texts])], ["tid", "text"])
    cut = [*in_pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 3)]), 1)]
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch, batch.slice(5, 3)]))
    assert all(x.num_rows == 1 or sum(len(t.as_py() or b"") for t in x.column(1)) <= 2 << 20 for x in cut)
