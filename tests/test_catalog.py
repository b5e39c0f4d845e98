"""Every query of the catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from casewright.plans import catalog
from tools.compare import rows_of

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["year", "total", "wins", "win_rate"]
    assert os.path.exists(e.__file__)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
