"""Every registered query against its SQL on the smallest data set."""

import pytest
from compare import check, duck

from tarn.checks import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    line = check(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert line.startswith("OK"), line


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
