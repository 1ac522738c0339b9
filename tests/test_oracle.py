"""Every registered query against its SQL on the given tables, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")


def test_every_library_query_has_sql():
    assert set(SQL) <= set(QUERIES)
    library = {n for n in QUERIES if not n.startswith("op") or not n[2:3].isdigit()} - {"pipeline"}
    assert library - set(SQL) == set()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, FOLDER, QUERIES[name], SQL[name], name)
    assert ok, message


def test_entry(spark):
    if FOLDER.endswith("sf0.001"):
        df = entry.entry(spark)
        assert df.count() > 0 and "icp_score" in df.columns
