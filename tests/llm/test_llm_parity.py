"""Registered queries of the training-data operators against their DuckDB SQL over the small tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from parity import duck, spark_rows, sql_rows

from docloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(duck(SF), SQL[name])


def test_distances_are_exact(spark):
    """To the last bit, as both add squares component by component."""
    got = {(r["query_id"], r["rank"]): r["score"] for r in QUERIES["op9_vector_graph"](spark, SF).collect()}
    rows = duck(SF).execute(SQL["op9_vector_graph"]).fetchall()
    assert got == {(q, rank): score for q, rank, _, score in rows}
