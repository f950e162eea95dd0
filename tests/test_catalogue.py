"""Every registered query of the graph against its SQL."""

import duckdb
import pytest

import __spark_entry__
from vectrail.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(spark, db, query, sql):
    d = query(spark, DATA)
    columns = sorted(d.columns)
    r = db.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    text = lambda rows: sorted(tuple(map(str, x)) for x in rows)
    assert text(tuple(x[c] for c in columns) for x in d.collect()) == text(tuple(x[i] for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    same(spark, db, QUERIES[name], SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
