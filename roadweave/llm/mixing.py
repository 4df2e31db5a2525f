"""Mixing sources to target weights in DataFrame functions alone: a golden-ratio schedule of sources over shuffled blocks of equal words."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, stored

#: Words of a block at most: what a slot of the schedule takes of its source.
BLOCK = 64
#: Weights of the sources in order, repeating, and how often a document may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Points are integers below 2 ** BITS; the step is the golden ratio's inverse of that, made odd.
BITS = 60
GOLDEN = (math.isqrt(5 << 2 * BITS) - (1 << BITS)) >> 1 | 1
LIMB = (1 << 30) - 1


@dataclass
class Mix:
    """What ``mix`` returns.

    documents: id, size, source, source_size, target, taken - one row a row of the input.
    sources: source, s (its place), size, weight, target, blocks.
    schedule: slot, s, epoch, block - which block of which source each slot takes.
    pieces: id, size, source, s, start (in its source's order), block, offset (first word within the text), words.
    """

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sums_before(rows: DataFrame, group: list[str], part: str, order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """``rows`` (best stored) with the sums over the rows before in their group's order, whose first key is ``part``.

    Two windows take the place of one over a whole group: over the parts' totals, and within a part.
    """
    totals = rows.groupBy(*group, part).agg(*[F.sum(c).alias(f"{n}__part") for n, c in sums.items()])
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    over = before.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, part, *[F.coalesce(F.sum(f"{n}__part").over(over), F.lit(0)).alias(f"{n}__part") for n in sums])
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{n}__in") for n, c in sums.items()])
    out = local.join(totals, [*group, part])
    return out.withColumns({n: F.col(f"{n}__part") + F.col(f"{n}__in") for n in sums}).drop(*[f"{n}__{k}" for n in sums for k in ("part", "in")])


def _targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sources`` with target: the shares of all words by weight, stopped at ``most`` times a source's size, the excess reshared until none is above.

    A round adds up what is stopped so far: three numbers. Whole numbers decide, so that no rounding does.
    """
    exact = lambda c: F.expr(f"CAST({c} AS DECIMAL(19, 0))")
    total, weight = (v or 0 for v in sources.agg(F.sum("size"), F.sum("weight")).first())
    stopped_n, left, shared = -1, total, weight
    above = F.lit(False)
    while shared:
        above = exact(f"{most} * size") * exact(shared) < exact("weight") * exact(left)
        n, size, w = sources.where(above).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == stopped_n:
            break
        stopped_n, left, shared = n, total - most * size, weight - w
    share = F.col("weight") * left / F.lit(float(shared or 1))
    return sources.withColumn("target", F.when(above, (most * F.col("size")).cast("double")).otherwise(share.cast("double")))


def points(slot: Column) -> Column:
    """Golden-ratio points as integers below 2 ** 60: slot * GOLDEN modulo that, in limbs of 30 bits, so that nothing passes 64 bits."""
    g1, g0 = GOLDEN >> 30, GOLDEN & LIMB
    i1, i0 = F.shiftright(slot, 30), slot.bitwiseAND(LIMB)
    high = F.shiftleft((i1 * g0 + i0 * g1).bitwiseAND(LIMB), 30)
    return (i0 * g0 + high).bitwiseAND((1 << BITS) - 1)


def _schedule(sources: DataFrame, most: int) -> DataFrame:
    """slot, s, epoch, block: a slot's point falls into its source's part of the cumulative weights, its rank among the source's slots names the block."""
    slots, total, n = sources.agg(F.ceil(F.sum("need") / 65536).cast("long"), F.sum("need"), F.count("*")).first()
    slots, total = slots or 0, total or 1
    bound = lambda c: F.expr(f"CAST({c} AS DECIMAL(19, 0)) * CAST({1 << BITS} AS DECIMAL(19, 0)) div CAST({total} AS DECIMAL(19, 0))")
    # Points and sources meet in the cells of a grid, about four cells a source.
    grid = BITS - max(4, (4 * n).bit_length())
    parts = sources.where("need > 0").withColumns({"low": bound("before"), "high": bound("before + need")}).where("high > low")
    parts = parts.select("s", "blocks", "low", "high", F.explode(F.sequence(F.shiftright("low", grid), F.shiftright(F.col("high") - 1, grid))).alias("cell"))
    drawn = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("u")).withColumn("cell", F.shiftright("u", grid))
    drawn = drawn.join(parts, "cell").where("u >= low AND u < high")
    drawn = stored(drawn.select("slot", "s", "blocks", F.expr(f"slot div {math.isqrt(slots) + 1}").alias("chunk")))
    ranked = _sums_before(drawn, ["s"], "chunk", ["slot"], rank=F.lit(1))
    return ranked.select("slot", "s", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block")).where(F.col("epoch") < most)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = "0") -> Mix:
    """A mix of all documents in which each source's share of words comes near its target.

    A document's size is its number of words (null text: 0). Sources in the order of code points, null last, have ``weights``,
    repeating, and share the sizes' sum; targets stop at ``most`` times their source's size and the excess is reshared. A
    source's documents are put in the order of a hash of ``seed`` and their ids (of one id: the shorter first), and their
    words cut into blocks of at most ``block`` words that differ by one word at most. The schedule has as many slots as
    the targets have blocks. Slot i's golden-ratio point picks the source, and the slot is the source's next, so it takes
    its next block; after the last one a new epoch begins. Slots beyond ``most`` epochs stay empty, so no document is
    taken oftener. A source's taken words differ from its target by a few blocks. The same rows give the same mix in any
    order and partitioning. Repeated rows are documents of their own; null ids are one id; empty tables give empty ones.

    No window spans a source, as one may hold a third of all rows: a source's documents lie in about as many hash ranges as
    the square root of their number, and so do slots. Sources may be many: they are ordered by ranges and joined, and Spark
    broadcasts them only below its own limit of size.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("hash"), F.xxhash64(text_col).alias("tie"))
    rows = stored(rows)
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    order = [F.col("source").isNull(), F.col("source")]
    by_source = stored(by_source.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    placed = _sums_before(by_source, [], "range", order, s=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    placed = stored(placed.withColumns({"weight": weight.cast("long"), "blocks": F.ceil(F.col("size") / block).cast("long")}))
    need = F.when(F.col("size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("size") * 65536)).otherwise(0).cast("long")
    sources = stored(_sums_before(stored(_targets(placed, weights, most).withColumn("need", need)), [], "range", [F.col("s")], before=F.col("need")))
    schedule = _schedule(sources, most)

    own = sources.select(F.col("source").alias("__source"), "s", F.col("size").alias("source_size"), "target", "blocks", F.ceil(F.sqrt("docs")).cast("long").alias("hash_ranges"))
    in_range = F.expr("CAST(conv(substring(hash, 1, 8), 16, 10) AS BIGINT) * hash_ranges DIV 4294967296")
    dealt = rows.join(own, rows["source"].eqNullSafe(own["__source"])).drop("__source").withColumn("hash_range", in_range).drop("hash_ranges")
    laid = _sums_before(dealt, ["s"], "hash_range", ["hash", "size", "tie"], start=F.col("size"))
    # The first ``longer`` blocks have one word more than the others.
    laid = laid.withColumns({"each": F.expr("source_size div greatest(blocks, 1)"), "longer": F.expr("source_size % greatest(blocks, 1)")})
    block_of = lambda x: F.expr(f"CASE WHEN {x} < longer * (each + 1) THEN ({x}) div (each + 1) ELSE longer + ({x} - longer * (each + 1)) div each END")
    begin = lambda b: F.expr(f"({b}) * each + least({b}, longer)")
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(block_of("start"), block_of("start + size - 1"))))
    first, last = F.greatest("start", begin("block")), F.least(F.col("start") + F.col("size"), begin("block + 1"))
    keep = ["id", "size", "source", "s", "source_size", "target", "start"]
    pieces = pieces.select(*keep, "block", (first - F.col("start")).alias("offset"), (last - first).alias("words"))
    met = pieces.join(schedule.select("s", "block", "slot"), ["s", "block"], "left")
    taken = met.groupBy(*keep).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).alias("taken"))
    columns = ["id", "size", "source", "source_size", "target"]
    documents = taken.select(*columns, "taken").union(dealt.where("size = 0").select(*columns, F.lit(0).cast("long")))
    discard(by_source, placed)
    return Mix(documents, sources.select("source", "s", "size", "weight", "target", "blocks"), schedule, pieces.drop("source_size", "target"))


def mixture(m: Mix) -> DataFrame:
    """slot, source, epoch, id, offset, words: what stands where in the mix, a row a piece of a text, by the word within it."""
    return m.schedule.join(m.pieces, ["s", "block"]).select("slot", "source", "epoch", "id", "offset", "words")


def sql(block: int = BLOCK, most: int = MOST, weights: Sequence[int] = WEIGHTS, seed: str = "0") -> str:
    """The same in DuckDB's SQL: the number of a source's points gives what of its order is taken how often."""
    g1, g0, every = GOLDEN >> 30, GOLDEN & LIMB, (1 << BITS) - 1
    return rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents
),
o AS (SELECT source, sum(size)::HUGEINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM d GROUP BY source),
w AS (SELECT *, list_extract({list(weights)}, (s % {len(weights)})::INT + 1)::HUGEINT AS weight, ceil(size / {block})::HUGEINT AS blocks FROM o),
c AS (
  SELECT *, sum(size) OVER () AS total,
    sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS shared, sum(size) OVER () - {most} * coalesce(sum(size) OVER f, 0) AS rest
  FROM w WINDOW f AS (ORDER BY size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
k AS (SELECT *, {most} * size * shared < weight * rest AS above FROM c),
l AS (SELECT *, sum(weight) FILTER (NOT above) OVER () AS open_weight, total - {most} * coalesce(sum(size) FILTER (above) OVER (), 0) AS open_words FROM k),
t AS (SELECT *, CASE WHEN above THEN ({most} * size)::DOUBLE ELSE (weight * open_words)::DOUBLE / open_weight::DOUBLE END AS target FROM l),
n AS (SELECT *, CASE WHEN size > 0 THEN round(target * blocks::DOUBLE / size::DOUBLE * 65536)::HUGEINT ELSE 0 END AS need FROM t),
b AS (
  SELECT *, coalesce(sum(need) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before, (sum(need) OVER ())::HUGEINT AS needed FROM n
),
p AS (
  SELECT (i0 * {g0} + ((((i1 * {g0} + i0 * {g1}) & {LIMB}) << 30))) & {every} AS u
  FROM (SELECT i >> 30 AS i1, i & {LIMB} AS i0 FROM (SELECT unnest(range(ceil((SELECT max(needed) FROM b) / 65536)::BIGINT)) AS i))
),
q AS (
  SELECT s, count(*) AS drawn FROM p JOIN b ON need > 0 AND u >= before * {1 << BITS} // needed AND u < (before + need) * {1 << BITS} // needed GROUP BY s
),
r AS (
  SELECT b.*, least(coalesce(drawn, 0), {most} * blocks) // greatest(blocks, 1) AS whole, least(coalesce(drawn, 0), {most} * blocks) % greatest(blocks, 1) AS more
  FROM b LEFT JOIN q USING (s)
),
a AS (
  SELECT d.doc_id, d.size, r.size AS source_size, target, whole, more * (r.size // greatest(blocks, 1)) + least(more, r.size % greatest(blocks, 1)) AS cut,
    coalesce(sum(d.size) OVER (PARTITION BY s ORDER BY hash, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (whole * size + greatest(0, least(size, cut - start)))::BIGINT AS taken FROM a
"""
