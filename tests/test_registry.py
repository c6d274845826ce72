"""Every registered query against its DuckDB counterpart on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from mnemix.plans import registry
from mnemix.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared_memory():
    """One build of the memory serves all queries of these tests."""
    registry.SHARED = {}
    yield
    registry.SHARED = None


def rows(d):
    d = d[sorted(d.columns)]
    return d.sort_values(list(d.columns), key=lambda c: c.astype(str) if c.dtype == object else c).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query(spark, duck, name):
    a, b = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-6, equal_nan=True), c
        elif b[c].dtype.kind != "M":
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
