"""Every registered query against its SQL on the smallest tables."""

import pytest
from verify import compare

import __spark_entry__ as contract
from foliospark.plans import QUERIES, SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    assert name in SQL
    # The only query that may be empty on so little data lists absent companies of few, rich orders.
    assert compare(df, con, SQL[name]) in ((None, "no rows") if name == "x1_absent_companies" else (None,))


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.entry(spark).columns) == 19
