"""Every registered query against its oracle, and none of them empty by accident."""

import pytest

from terravia import catalog
from tests.conftest import SF, duck, same

ENTRIES = catalog.entries()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.oracle])
def test_oracle(spark, con, name):
    same(ENTRIES[name].query(spark, SF), con, ENTRIES[name].oracle)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.oracle])
def test_rows(spark, name):
    assert ENTRIES[name].query(spark, SF).count() > 0
