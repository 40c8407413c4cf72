"""Every registered query against its SQL on the smallest tables."""

import pytest
from check_oracles import compare, connect
from conftest import SF_DIR

from veritrace.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, QUERIES, ORACLES) == ""


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
