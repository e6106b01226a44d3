"""The registered queries of the package that SQL can express, against their SQL; all of them run."""

import pytest

from tallyframe.llm.queries import QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    make, sql = QUERIES[name]
    if sql is None:
        assert make(spark, FOLDER).count() >= 200
    else:
        assert differences(spark, connect(FOLDER), make, sql, FOLDER) == ""
