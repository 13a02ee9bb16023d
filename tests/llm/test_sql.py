"""Operators whose result SQL can state, against it."""

from __future__ import annotations

import pytest

from checks.compare import compare
from tests.conftest import SMALL
from tradeloom.llm import decontam, ngram_join, substring_dedup


@pytest.mark.parametrize("module", [decontam, ngram_join, substring_dedup])
def test_equals_sql(spark, module):
    assert compare(spark, SMALL, module.__name__, module.query, module.ORACLE) == ""
