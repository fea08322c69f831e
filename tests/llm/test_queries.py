import math
import os

import duckdb
import pytest

from ratiotree.llm import queries

TABLES = "documents pages benchmark labels conversations".split()
SQL = queries.oracle_sql()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert order(got.select(*columns).collect()) == order(want.fetchall())


def test_queries_without_sql_run(spark, sf_dir):
    for name in sorted(set(queries.queries()) - set(SQL) - {"pipeline"}):
        assert queries.queries()[name](spark, sf_dir).count() > 0, name
