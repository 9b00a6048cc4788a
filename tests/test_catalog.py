"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import pytest

from prismwell.plans import catalog

from .oracle import duckdb_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, name):
    columns, rows = spark_rows(catalog.QUERIES[name](spark, SF))
    want_columns, want = duckdb_rows(catalog.ORACLE[name], SF)
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).collect()
