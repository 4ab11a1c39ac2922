"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from quillmark import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(name, same_as_duckdb):
    same_as_duckdb(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
