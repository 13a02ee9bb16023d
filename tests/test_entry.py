"""The registered queries agree with their SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from tests.conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
if entry.corpus:  # tested on their own
    QUERIES = {k: v for k, v in QUERIES.items() if k not in entry.corpus.queries()}
    SQL = {k: v for k, v in SQL.items() if k not in entry.corpus.queries()}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert compare(spark, SMALL, name, QUERIES[name], SQL[name]) == ""
