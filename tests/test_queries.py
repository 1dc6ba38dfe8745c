"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_the_training_report_lacks_sql():
    assert set(QUERIES) - set(ORACLES) == {"S14_training_report"}


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
