"""Every named query against its DuckDB twin on the smallest tables."""

import pytest

from spanledger.plans import catalog
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        assert compare(got, con.execute(catalog.ORACLES[name]).fetchdf()) == "ok"
    else:
        assert len(got) > 0


def test_catalog_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_pins(spark):
    rows = {r.file: r.status for r in catalog.QUERIES["pinned_files"](spark, SF).collect()}
    assert rows["part.parquet"] == "mismatch" and rows["region.parquet"] == "unpinned"
    assert rows["regions.parquet"] == "missing" and rows["orders.parquet"] == "ok"
