"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from tessera import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
    rows = lambda d: sorted(tuple(map(str, r)) for r in d.astype(object).where(d.notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)
