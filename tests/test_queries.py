"""Every query against its SQL in DuckDB; the others give rows and a stable schema."""

import math

import duckdb
import pytest

from tidewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(medium):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{medium}/{t}.parquet')")
    return con


def rows_of(rows, columns):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, medium, duck, name):
    df = registry.QUERIES[name](spark, medium)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = rows_of([r.asDict() for r in df.collect()], columns)
    assert got == rows_of([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, medium, name):
    df = registry.QUERIES[name](spark, medium)
    assert df.count() > 0 and len(df.schema) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 600
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
