"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
import workload.registry as registry
from workload.check import normal, oracle

SF_DIR = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = [r.asDict() for r in registry.queries()[name](spark, SF_DIR).collect()]
    assert normal(got) == normal(oracle(SF_DIR, registry.oracle_sql()[name]))
