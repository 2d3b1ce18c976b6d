"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""
import pytest

import __spark_entry__ as E
from featurespark.plans import registered
from tools.oracle_check import check
from tests.conftest import SF01

NAMES = sorted(registered.QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registered.QUERIES) == set(registered.ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    res = check([name], SF01, spark)[name]
    assert res[0] == "ok", res


def test_schemas_stable_across_scales(spark):
    """Each registered query has the same output schema at sf0.001 and sf0.01
    (one_hot's columns are data values, fixed across the driver's scales)."""
    from tests.conftest import SF001
    diff = []
    for name, fn in registered.QUERIES.items():
        a = fn(spark, SF001).schema.simpleString()
        b = fn(spark, SF01).schema.simpleString()
        if a != b:
            diff.append(name)
    assert diff == []
