"""Every registered query against its SQL over the generated tables."""

import os

import pytest

import __spark_entry__ as entry
from newsloom.plans import oracle
from newsloom.plans.queries import REGISTRY
from tests import compare

SF_DIR = os.environ.get("NEWSLOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_registry_is_covered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    columns, got = compare.spark_rows(entry.queries()[name](spark, SF_DIR))
    expected_columns, want, _ = compare.oracle_rows(duck, entry.oracle_sql()[name])
    assert sorted(columns) == sorted(expected_columns)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
