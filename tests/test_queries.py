"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest

import __spark_entry__ as driver
from suite.oracle import ORACLE
from suite.queries import QUERIES
from tests.compare import connect, difference, plan

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|ArrowEval|InPandas", plan(df))
    assert difference(df, db, ORACLE[name]) is None


@pytest.mark.parametrize("name", ["description_round_trip", "reload_and_enrich"])
def test_description_in_parts(spark, db, name):
    assert difference(QUERIES[name](spark, FOLDER, max_entries=3), db, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["subreddit", "feature", "item", "cnt"]
    assert df.count() > 0
