"""Dominance counting: for every row the rows of smaller slots with strictly larger levels, and what they stand for."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, stored

#: Rows that a task sweeps at most, about; and the rows of a batch, which query the Fenwick tree before they are added to it.
ROWS_PER_TASK, BATCH = 1 << 21, 256


def above(order: np.ndarray, level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number, and the sum of the weights, of rows with a smaller ``order`` and a strictly larger level.

    The rows are swept by order and level, so that of tied rows those before have no larger level and need no exclusion.
    A Fenwick tree holds counts and weights by compressed level, the largest first. A batch of rows queries it at once, is
    compared within itself, and is then added at once: the tree's steps are array operations.
    """
    n = len(order)
    sweep = np.lexsort((level, order))
    values, rank = np.unique(level, return_inverse=True)
    rank = (len(values) - 1 - rank.ravel())[sweep]
    added = np.stack([np.ones(n, np.int64), weight[sweep].astype(np.int64)], axis=1)
    tree = np.zeros((len(values) + 1, 2), np.int64)
    found = np.zeros((n, 2), np.int64)
    earlier = np.tri(BATCH, k=-1, dtype=bool)
    for a in range(0, n, BATCH):
        mine, mass = rank[a : a + BATCH], added[a : a + BATCH]
        total, at = found[a : a + BATCH], mine.copy()
        while at.any():
            total += tree[at]  # tree[0] stays 0
            at &= at - 1
        within = (mine[None, :] < mine[:, None]) & earlier[: len(mine), : len(mine)]
        total[:, 0] += within.sum(axis=1)
        total[:, 1] += np.where(within, mass[None, :, 1], 0).sum(axis=1)
        at, mass = mine + 1, mass
        while len(at):
            np.add.at(tree, at, mass)
            at = at + (at & -at)
            inside = at <= len(values)
            at, mass = at[inside], mass[inside]
    out = np.empty_like(found)
    out[sweep] = found
    return out[:, 0], out[:, 1]


def _swept(order: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to n_above and w_above what the rows of one partition give each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        n, w = above(rows[order].to_numpy(), rows["level"].to_numpy(), rows["weight"].to_numpy())
        for name, more in (("n_above", n), ("w_above", w)):
            rows = rows.set_column(rows.column_names.index(name), name, pa.array(rows[name].to_numpy() + more))
        yield from rows.to_batches(max_chunksize=1 << 16)

    return run


def _ranged(rows: DataFrame, parts: int, keys: tuple[str, ...], name: str, order: str) -> DataFrame:
    dealt = rows.repartitionByRange(parts, *keys).withColumn(name, F.spark_partition_id())
    return stored(dealt.mapInArrow(_swept(order), dealt.schema))


def counts_above(rows: DataFrame, id_col: str = "id", slot: str = "slot", level: str = "level", weight: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """id, slot, level, n_above, w_above: of every row the number of rows above it and the sum of their weights (1 each if not given).

    A row is above another if its slot is smaller and its level strictly larger; both are taken as long. Rows with a null
    slot or level are above none, and their own counts are null. Every row counts and gets its own result, repeated rows
    and ids too; a null weight counts 0; no rows give none. Ids may be of any type; other columns are left out.

    Three parts make up a count, and no key can be hot in any, as every row has a place of its own in both orders.
    Rows are range-partitioned by slot (then level and place) and each partition is swept. They are range-partitioned again by
    level (then slot and place) into buckets, and what earlier partitions have in the row's own bucket is swept likewise, in
    the partitions' order. What they have in higher buckets comes from the partitions' histograms over buckets, summed by a
    distributed scan: along the partitions for each bucket, then from the highest bucket down for each partition. Ties in
    level that a bucket's border cuts have larger slots above the border, so earlier partitions hold none of them. There
    are at most the square root of the rows' number of partitions unless that would make them larger than ``rows_per_task``.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    mass = F.lit(1) if weight is None else F.coalesce(F.col(weight).cast("long"), F.lit(0))
    base = rows.select(F.col(id_col).alias("id"), F.col(slot).cast("long").alias("slot"), F.col(level).cast("long").alias("level"), mass.cast("long").alias("weight"))
    base = stored(base.withColumn("place", F.monotonically_increasing_id()))
    valid = base.where("slot IS NOT NULL AND level IS NOT NULL")
    n = valid.count()
    parts = max(1, math.ceil(n / rows_per_task), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.isqrt(n)))
    start = valid.withColumns({"n_above": F.lit(0).cast("long"), "w_above": F.lit(0).cast("long")})
    by_slot = _ranged(start, parts, ("slot", "level", "place"), "part", "slot")
    by_level = _ranged(by_slot, parts, ("level", "slot", "place"), "bucket", "part")
    discard(by_slot)
    found = by_level.hint("merge").join(_histograms(by_level), ["part", "bucket"])
    sums = [(F.col(c) + F.col(f"{c}_far")).alias(c) for c in ("n_above", "w_above")]
    none = base.where("slot IS NULL OR level IS NULL").select("id", "slot", "level", *[F.lit(None).cast("long").alias(c) for c in ("n_above", "w_above")])
    return found.select("id", "slot", "level", *sums).union(none)


def _histograms(rows: DataFrame) -> DataFrame:
    """part, bucket, n_above_far, w_above_far: what earlier parts hold in higher buckets.

    A bucket's histogram has a row for every part up to the last, as sums of earlier parts are needed where a part has no
    row of that bucket; parts times buckets are about the number of rows at most.
    """
    cells = rows.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    last = cells.agg(F.max("part")).first()[0] or 0
    every = cells.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))
    full = every.join(cells.hint("merge"), ["bucket", "part"], "left")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy("part").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    scan = full.select("bucket", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "w")])
    return scan.select("bucket", "part", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_above_far") for c in ("n", "w")])


def minute(ts: Column) -> Column:
    """Whole minutes since 1970 of a timestamp without zone taken as UTC, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def sale_rows(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level, weight of ``sales``: the minute of sold_at, floor(100 * total + 0.5), and 1 + crc32(sale_id) modulo 5.

    A total that is not finite, or that no long holds, has no level.
    """
    kind = dict(sales.dtypes)["sold_at"]
    slot = F.floor(F.unix_seconds("sold_at") / 60) if kind == "timestamp" else minute(F.col("sold_at").cast("timestamp_ntz"))
    cents = F.floor(F.lit(100.0) * F.col("total").cast("double") + 0.5)
    level = F.when(F.abs(F.col("total").cast("double")) < 9e16, F.floor(cents / 1))
    weight = 1 + F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5
    return sales.select("sale_id", slot.cast("long").alias("slot"), level.cast("long").alias("level"), F.coalesce(weight, F.lit(1)).alias("weight"))


SQL = """
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
),
s AS (
  SELECT sale_id, floor(epoch_us(date_trunc('second', sold_at)) // 1000000 / 60)::BIGINT AS slot,
    CASE WHEN abs(total) < 9e16 THEN floor(floor(100 * total + 0.5) / 1)::BIGINT END AS level,
    1 + xor(list_reduce(list_concat([4294967295], list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda c, d: xor(steps[(xor(c, d) & 255) + 1], c >> 8)), 4294967295) % 5 AS weight
  FROM sales, t
),
a AS (
  SELECT j.sale_id, j.slot, j.level, count(*) AS n, sum(i.weight) AS w
  FROM s i JOIN s j ON i.slot < j.slot AND i.level > j.level GROUP BY ALL
)
SELECT s.sale_id, s.slot, s.level,
  CASE WHEN s.slot IS NULL OR s.level IS NULL THEN NULL ELSE coalesce(n, 0) END::BIGINT AS n_sales,
  CASE WHEN s.slot IS NULL OR s.level IS NULL THEN NULL ELSE coalesce(w, 0) END::BIGINT AS n_rows
FROM s LEFT JOIN a USING (sale_id)
"""
