"""The registered queries next to their comparison SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry
from tallyguard.plans.oracles import ORACLES
from tallyguard.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["nation", "category", "secrets", "files"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    problem = difference(spark, connection, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem == ""
