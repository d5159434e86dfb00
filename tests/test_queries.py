"""Every registered query agrees with its SQL on the smallest tables; those without SQL give rows of a stable schema."""

import datetime

import duckdb
import pytest

from tollhouse.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(catalog.ORACLES[name])
    assert sorted(sql.columns) == columns
    wanted = sorted((tuple(plain(dict(zip(sql.columns, r, strict=True))[c]) for c in columns) for r in sql.fetchall()), key=repr)
    assert found == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns == catalog.QUERIES[name](spark, sf).columns
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registered_without_a_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True)
