import duckdb
import pytest

from sparkferry.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in out.fetchall())
