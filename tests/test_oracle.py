"""DuckDB oracle parity for every query that has oracle SQL (sf0.001, fast)."""

import duckdb
import pytest

import __spark_entry__ as E
from raremetrics.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows):
    def v(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted(tuple(str(v(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in cur.fetchall()]
    assert _norm(srows) == _norm(drows)
