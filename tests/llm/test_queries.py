from pathlib import Path

import pytest

from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def _names():
    from kinloom.llm import queries

    return sorted(queries.queries())


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from kinloom.llm import queries

    query, sql = queries.queries()[name], queries.oracle_sql().get(name)
    if sql:
        assert compare(spark, connect(DATA), name, query, sql, DATA) == ""
    else:
        df = query(spark, DATA)
        assert df.count() > 0
        if name.endswith("_found"):
            assert df.count() == df.distinct().count()
