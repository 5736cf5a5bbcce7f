"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from skein.catalog import ORACLES, QUERIES
from skein.plans.base import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    """Values rounded so that the last digit of a float can't part them."""
    return sorted(repr(tuple(round(float(x), 4) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(want.fetchall())


def test_rows_only(spark, sf):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, sf).count() > 0, name
