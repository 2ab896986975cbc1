"""Every registered query against its SQL twin, over whole tables."""

import os

import pytest
from compare import connect, differences

from tabletrail import suite

FOLDER = os.environ.get("SUITE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query(spark, connection, name):
    df = suite.queries()[name](spark, FOLDER)
    sql = suite.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, connection, sql) is None


@pytest.mark.parametrize("name", ["group_zscore_outliers", "bh_adjust", "audit_inputs", "audit_identity_preserved", "typed_elements"])
def test_query_without_any_broadcast(spark, connection, monkeypatch, name):
    """The shuffle route, with hot keys split, gives the same rows."""
    from tabletrail.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    assert differences(suite.queries()[name](spark, FOLDER), connection, suite.oracle_sql()[name]) is None


def test_every_query_has_a_sql_twin():
    assert set(suite.queries()) == set(suite.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["batch", "group", "n", "mean_intensity", "min_p"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
