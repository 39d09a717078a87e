import pytest

import __spark_entry__ as entry
from millrace.plans.registry import ORACLES, PLANS
from tests.oracle import connection, mismatch

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(SF_DIR)


def test_every_query_has_its_sql():
    assert set(PLANS) == set(ORACLES)
    assert set(PLANS) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(PLANS))
def test_query_matches_sql(spark, db, name):
    assert mismatch(entry.queries()[name](spark, SF_DIR), db, entry.oracle_sql()[name]) is None


def test_entry(spark):
    records = entry.entry(spark)
    assert records.columns == ["url", "title", "depth", "ts"]
    assert records.count() > 0
