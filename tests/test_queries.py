"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"

# ten suppliers only, none overdrawn
EMPTY_AT_THIS_SCALE = {"overdrawn_supplier_hops"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_matches_sql(spark, con, name):
    problem = compare(spark, con, name, SF)
    assert problem is None or (problem == "both empty" and name in EMPTY_AT_THIS_SCALE)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
