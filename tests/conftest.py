import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kinloom.session import build_session

    s = build_session("tests", master="local[4]", partitions=4)
    yield s
    s.stop()


@pytest.fixture
def rows(spark):
    """Makes a DataFrame from rows and a DDL schema."""
    return lambda data, ddl: spark.createDataFrame(data, ddl)
