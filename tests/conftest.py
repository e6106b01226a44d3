import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallyframe.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions="4")
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(spark):
    """Force the oversized-group ways on small data."""
    spark.conf.set("spark.tallyframe.groupRows", "7")
    yield spark
    spark.conf.unset("spark.tallyframe.groupRows")
