"""Each query against its SQL in DuckDB, on the smallest tables; those without SQL must run and give rows."""

import math

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(canon, x)) + "]"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in plans.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert columns == sorted(names)
    want = sorted(tuple(canon(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(canon(r[c]) for c in columns) for r in rows) == want
