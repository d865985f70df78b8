"""Every registered query of the road graph against its SQL on the smallest tables."""

import os

import pytest

from wayfold.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None else v if isinstance(v, (int, float, bool)) else str(v)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = duck.sql(plans.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
