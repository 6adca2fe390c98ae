import math

import duckdb
import pytest

from tempora.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    df, ref = QUERIES[name](spark, sf), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(ref.columns)
    want = sorted(tuple(map(plain, r)) for r in ref.select(*(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want
