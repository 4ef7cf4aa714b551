"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from quire.plans import catalog
from quire.session import TABLES

SF = os.environ.get("QUIRE_TEST_SF", "/root/testdata/sf0.001")
catalog.load_all()
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def digest(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    got = pd.DataFrame([r.asDict(recursive=True) for r in sdf.collect()], columns=sdf.columns)
    if name not in ORACLES:
        assert len(sdf.columns) > 0
        return
    want = con.execute(ORACLES[name]).df()
    assert digest(got) == digest(want)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["patient_id"] and df.count() >= 0
