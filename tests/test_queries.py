"""Each query against its SQL twin on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from compare import difference

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(result, duck, ORACLES[name]) is None
    assert result.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
