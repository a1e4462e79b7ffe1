import os
from collections import Counter

import duckdb
import pytest

from kervan.plans.catalog import QUERIES
from kervan.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(str(r[i]) for i in order) for r in values)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLE:
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for f in os.listdir(DATA):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
        r = con.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(r.columns)
        assert got == rows(r.columns, r.fetchall())
