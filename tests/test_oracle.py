"""Every registered query against its checking SQL, on the smallest data."""

import pytest

from catalog import CATALOG
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    rows, problems = compare(spark, con, CATALOG[name], SF)
    assert not problems, "\n".join(problems)
    assert rows >= 0
