"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

from pathlib import Path

import pytest

from tests.oracle import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def _names():
    from kinloom.plans import registry

    return sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from kinloom.plans import registry

    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        assert compare(spark, con, name, query, sql, DATA) == ""
    else:
        assert query(spark, DATA).count() > 0


def test_partitions_do_not_change_results(spark):
    from kinloom.plans import registry

    seen = set()
    for n in ("1", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(str, registry.flagship(spark, DATA).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1
