import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import dominance
from roadweave.llm.queries import op13_dominance_counting

SF = "/root/testdata/sf0.01"


def brute(rows):
    """(id, slot, level, n, w) from (id, slot, level, weight)."""
    good = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for i, s, v, _ in rows:
        if s is None or v is None:
            out.append((i, s, v, None, None))
        else:
            up = [w for _, a, b, w in good if a < s and b > v]
            out.append((i, s, v, len(up), sum(up)))
    return out


def key(r):
    return [(x is None, x if x is not None else 0) for x in r]


@pytest.mark.parametrize("n,slots,levels", [(0, 1, 1), (1, 1, 1), (700, 5, 4), (1500, 400, 900), (900, 1, 50), (900, 50, 1)])
def test_sweep(n, slots, levels):
    rng = np.random.default_rng(n + slots)
    s, v, w = rng.integers(0, slots, n), rng.integers(-levels, levels, n), rng.integers(0, 9, n)
    got = dominance.above(s, v, w)
    up = (s[None, :] < s[:, None]) & (v[None, :] > v[:, None])
    assert (got[0] == up.sum(axis=1)).all() and (got[1] == (up * w[None, :]).sum(axis=1)).all()


@pytest.mark.parametrize("slots,levels", [(3, 5), (40, 1), (1, 40), (60, 60)])
def test_partitions_and_buckets(spark, slots, levels):
    """Slots and levels that ranges cut, a third of the rows with one slot, one level and one id, nulls, and repeated rows."""
    rng = np.random.default_rng(slots * 100 + levels)
    rows = [(f"k{i}", int(rng.integers(slots)), int(rng.integers(levels)), int(rng.integers(1, 6))) for i in range(500)]
    rows += [("hot", slots // 2, levels // 2, 2)] * 250 + [("a", None, 3, 1), ("b", 2, None, 1), (None, 0, 1, 4), ("c", None, None, 1)]
    df = spark.createDataFrame(rows, "id string, slot int, level int, weight int").withColumn("part", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("place", F.lit(0))
    got = [tuple(r) for r in dominance.counts_above(df, weight="weight", rows_per_task=60).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    plain = dominance.counts_above(df, rows_per_task=1000).where("id = 'hot'").select("n_above", "w_above").distinct().collect()
    assert len(plain) == 1 and plain[0].n_above == plain[0].w_above


def test_empty_and_null_weights(spark):
    none = spark.createDataFrame([], "id long, slot long, level long, weight long")
    assert dominance.counts_above(none, weight="weight").count() == 0
    df = spark.createDataFrame([(1, 0, 5, None), (2, 1, 3, 7)], "id long, slot long, level long, weight long")
    assert sorted(tuple(r) for r in dominance.counts_above(df, weight="weight").collect()) == [(1, 0, 5, 0, 0), (2, 1, 3, 1, 0)]


def test_slots_in_any_zone(spark):
    rows = [("2024-03-31 02:30:59.9", 10.005, 7), ("1969-12-31 23:59:30", 0.29, 8), (None, None, 9), ("2024-01-01 00:00:00", float("nan"), 10), ("2024-01-01 00:01:00", float("inf"), None)]
    df = spark.createDataFrame(rows, "t string, total double, sale_id long").select(F.col("t").cast("timestamp_ntz").alias("sold_at"), "total", "sale_id")
    want = {7: (28530870 + 1440 * 0, 1001), 8: (-1, 29), 9: (None, None), 10: (28401120, None), None: (28401121, None)}
    want[7] = ((np.datetime64("2024-03-31T02:30") - np.datetime64("1970-01-01T00:00")).astype(int), 1001 if 100 * 10.005 + 0.5 >= 1001 else 1000)
    try:
        for zone in ("UTC", "Europe/Berlin", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r.sale_id: r for r in dominance.sale_rows(df).collect()}
            assert {k: (r.slot, r.level) for k, r in got.items()} == want
            assert got[7].weight == 1 + zlib.crc32(b"7") % 5 and got[None].weight == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view sales as select * from '{SF}/sales.parquet'")
    want = con.execute(dominance.SQL).fetchall()
    got = op13_dominance_counting(spark, SF)
    assert got.columns == ["sale_id", "slot", "level", "n_sales", "n_rows"] and [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
