"""Every registered query against its SQL on the same tables."""

import pytest

from checks.compare import duck, oracle_rows, spark_rows
from checks.oracles import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, sf_dir, con, name):
    assert spark_rows(spark, name, sf_dir) == oracle_rows(con, name)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).limit(1).count() == 1
