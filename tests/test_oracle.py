"""Every registered query against its DuckDB statement, on whole tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from narraplan.plans.oracle import ORACLE as LIBRARY_ORACLE
from narraplan.plans.queries import QUERIES as LIBRARY

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_stated():
    """The library's own queries all have a statement; operators of llm without one are tested by brute force."""
    assert set(LIBRARY_ORACLE) == set(LIBRARY)
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_statement(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], ORACLE[name]) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["script_id", "scene", "start", "end", "text", "keywords"]
