"""Every query with SQL gives the same rows on the smallest tables; the others run."""

from __future__ import annotations

import pytest

from isovane import queries
from tests.compare import differing

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()
#: Wavefronts and routes have tests of their own.
LONG = {"g9_h5_oriented_normals", "g12_h7_flip_chain", "g6_route", "d24_brush_planarity"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differing(spark, SF, queries.queries()[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL) - LONG))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() >= 0
