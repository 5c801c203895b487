"""Every registered query against its SQL on the smallest data."""

import pytest
from check_oracle import compare, connect
from conftest import SF_DIR

import __spark_entry__ as contract
from postweave.plans.registry import ORACLES as SQL
from postweave.plans.registry import QUERIES


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    frame = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(frame, db, SQL[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["rank", "job_id", "score"]


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())
