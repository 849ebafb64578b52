import pytest

import __spark_entry__ as entry
from auditlake.registry.oracle import ORACLE
from auditlake.registry.spark_queries import QUERIES
from tools.check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"
# Diff text is the standard library's; it is checked against it elsewhere.
ROWS_ONLY = {"unified_diffs", "snapshot_diffs"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, rows = compare(spark, con, SF_DIR, name)
    assert verdict == ("rows only" if name in ROWS_ONLY else "equal")
    assert rows > 0
