"""Every query of the engine that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lakeward import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, tables, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(map(plain, r)) for r in frame.select(columns).collect()), key=repr)
    listed = ",".join(f'"{c}"' for c in columns)
    expected = sorted((tuple(map(plain, r)) for r in tables.sql(f"select {listed} from ({catalog.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
