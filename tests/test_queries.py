"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from compare import connect, diff  # noqa: E402

from txguard.oracles import all_sql  # noqa: E402
from txguard.queries import all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, con, name):
    assert diff(spark, con, all_queries()[name], all_sql()[name], SF) is None


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 1000
