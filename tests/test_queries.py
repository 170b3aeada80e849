"""Every query against the SQL that says the same."""

import pytest

import oracle
from silverloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = oracle.spark_rows(QUERIES[name](spark, small))
    if name in ORACLE_SQL:
        assert got == oracle.duck_rows(ORACLE_SQL[name], small)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
