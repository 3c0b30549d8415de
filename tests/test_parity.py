"""Registered queries against DuckDB over the small tables; those without SQL run."""

from __future__ import annotations

from pathlib import Path

import pytest
from parity import duck, spark_rows, sql_rows

from docloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    if name in SQL:
        assert (columns, rows) == sql_rows(con, SQL[name])
    else:
        assert columns
