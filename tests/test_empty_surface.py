"""Queries on a volume whose values are alike, so that no voxel reaches the iso value and there is no surface."""

from __future__ import annotations

import datetime
import os

import pytest

from isovane import queries
from isovane.operators import normals, target
from isovane.queries.surface import _grid
from tests.compare import TABLES, differing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    """The smallest tables with two line items at each place: a mean of 2, an iso value of 3."""
    top = tmp_path_factory.mktemp("flat")
    for name in TABLES:
        os.symlink(f"{SF}/{name}.parquet", top / f"{name}.parquet")
    os.unlink(top / "lineitem.parquet")
    rows = [(part, supplier, datetime.date(1995, 1, day)) for part in range(6) for supplier in range(4) for day in range(1, 6)] * 2
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_shipdate date").write.parquet(str(top / "lineitem.parquet"))
    grid, iso = _grid(spark, str(top))
    assert iso == 3 and grid.voxels.count() == 120 and target.core_voxels(grid, iso).isEmpty()
    return str(top)


def like(spark, name, flat):
    """Rows of the query without a surface, whose columns must be those that it has elsewhere."""
    found = queries.queries()[name](spark, flat)
    assert found.dtypes == queries.queries()[name](spark, SF).dtypes
    return found.collect()


def test_nothing_to_orient(spark, flat):
    assert like(spark, "g9_h5_oriented_normals", flat) == []


def test_nothing_to_flip(spark, flat):
    assert like(spark, "g12_h7_flip_chain", flat) == []


def test_no_start_of_a_flip(spark):
    lone = spark.createDataFrame([(0, 0, 0, "core", 0.0, 0.0, 1.0)], "x int, y int, z int, kind string, nx double, ny double, nz double")
    assert normals.flip_preview(lone, None).collect() == []
    assert normals.flip_preview(lone, (0, 0, 0)).count() == 1


def test_no_route(spark, flat):
    assert like(spark, "g6_route", flat) == []


def test_no_pairs_as_in_sql(spark, flat):
    assert differing(spark, flat, queries.queries()["c16_adjacency"], queries.oracle_sql()["c16_adjacency"]) == ""
