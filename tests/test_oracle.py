"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from roadweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    nulls_last = lambda t: [(x is None, 0 if x is None else x) for x in t]
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=nulls_last)
    assert got
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(row[names.index(c)] for c in cols) for row in cur.fetchall()), key=nulls_last)
        assert len(got) == len(want)
        close = lambda a, b: a == b or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 1e-6 * max(1, abs(a))
        assert all(close(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True)), [(g, w) for g, w in zip(got, want, strict=True) if g != w][:3]
