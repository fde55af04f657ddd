"""Corpus queries with SQL agree with DuckDB on the smallest data."""

from __future__ import annotations

import pytest

from tessera.llm import catalog
from tests.conftest import SF
from tests.helpers import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    names, got = rows_of(catalog.QUERIES[name](spark, SF))
    want_names, want = duck_rows(catalog.ORACLES[name], SF)
    assert names == want_names
    assert got == want
