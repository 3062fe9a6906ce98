"""Every query against its oracle SQL on the smallest tables; queries without one must give rows."""

import pytest

from suite import ALL_ORACLES, ALL_QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, duck, name):
    verdict, rows = compare(spark, duck, ALL_QUERIES[name], ALL_ORACLES.get(name), SF)
    assert verdict == "ok"
    if name not in ("e06_fill_shortfall", "b21_code_in_any"):
        assert rows > 0
