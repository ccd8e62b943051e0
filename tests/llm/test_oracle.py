"""Operators that SQL can restate, held against it."""

import pytest
from oracle import compare

from orestrata.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], sf_dir) == ""
