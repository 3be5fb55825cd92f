"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import duck, duck_rows, spark_rows
from meterlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(con, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
