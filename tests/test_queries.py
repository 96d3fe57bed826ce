"""Every query of the library against its SQL; those without SQL must give rows."""

import pytest

from terracite.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
