"""Every query with SQL equals DuckDB's answer; the others run and give rows."""

import math

import duckdb
import pytest

from sluicebox.plans import queries
from sluicebox.session import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(row):
    return tuple(f"{float(x):.7g}" if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {listed} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(plain(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()) == sorted(plain(r) for r in want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_gives_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
