"""Every registered query against its SQL on the smallest tables."""

import importlib

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
from loomtext import queries as base  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_against_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    assert name in entry.oracle_sql()
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["path", "source", "score"] and got.count() > 0
