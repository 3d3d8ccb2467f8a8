"""Every registered query of the engine equals its SQL on an independent engine; the few that have none are held against plain loops in test_semantics and test_planar."""

import pytest

from skeinql import queries as engine

DATA = "/root/testdata/sf0.001"
ALL, ORACLES = engine.queries(), engine.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, duck, same):
    same(ALL[name](spark, DATA), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(ALL) - set(ORACLES)))
def test_runs(name, spark):
    assert ALL[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
