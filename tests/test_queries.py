"""Every query on the site tables against its SQL twin in DuckDB."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_twin(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.sql(ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES))
def test_runs(spark, sf_dir, name):
    """Rows without a null in any column; what they hold is tested in test_models.py."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and all(v is not None for r in rows for v in r)
