"""Every registered SQL form agrees with its Spark form on the smallest tables."""

import pytest

from ledgerlens.plans.catalog import QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, connect

CHECKED = [n for n, q in QUERIES.items() if q.sql]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, con, name):
    difference, _ = compare(spark, con, QUERIES[name], SMALL)
    assert difference in ("", "ROUNDING"), difference


def test_most_queries_have_sql():
    assert len(CHECKED) >= 0.8 * len(QUERIES)
