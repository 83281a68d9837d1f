"""Operators that SQL can express against their SQL, on the smallest given tables."""

import pytest

from cairn.llm import registry
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE[name])
