"""Every registered query against its SQL oracle on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from docloom.plans import registries

NAMES = [name for r in registries() for name in r.queries]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message, _, _ = compare(spark, con, FOLDER, name)
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "pos", "link"] and df.count() > 0
