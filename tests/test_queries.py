"""Every registered query against its SQL on the smallest tables."""

import pytest

from tallyframe.plans import all_queries
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    make, sql = QUERIES[name]
    if sql is None:
        assert make(spark, FOLDER).limit(1).count() == 1
    else:
        assert differences(spark, con, make, sql, FOLDER) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
