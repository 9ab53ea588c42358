"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from contactline.plans.queries import REGISTERED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(REGISTERED) <= set(oracle_sql())
    assert set(REGISTERED) <= set(queries())


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and {r["Status"] for r in rows} <= {"Success", "Failed"}
    for r in rows:  # success exactly when some category is filled
        assert (r["Status"] == "Success") == (r["n_addresses"] > 0)
