"""Every query with SQL equals DuckDB's answer on the smallest tables; the others give rows."""

import duckdb
import numpy as np
import pytest

from nichespark.plans.oracles import oracle_sql
from nichespark.plans.queries import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or isinstance(x, (float, np.floating)) and np.isnan(x):
            return None
        return round(float(x), 9) + 0.0 if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA).toPandas()
    if sql := oracle_sql().get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
