"""What the operators of this package share: reading, checkpoints, bounded Arrow batches."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, discard, stored  # noqa: F401

#: Bytes of text that one Arrow batch carries, and that one numpy pass handles at a time.
BATCH_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are limited by bytes too, as 10,000 very long texts would not fit a worker.

    The session keeps the lower limits, as plans are made when they run, not here; limits that are lower already stay.
    """
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4000)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: Rows of one key from which it counts as hot, and the share of all rows: so no more than 10,000 keys are hot.
HOT_ROWS, HOT_SHARE = 250, 10_000


def join_by_hot_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner-joined with ``table`` (best a checkpoint), whose ``key`` is unique and whose ``count`` tells how many rows have it.

    Keys with over HOT_ROWS rows and over one in HOT_SHARE of all are 10,000 at most. Only they and their numbers of parts
    are broadcast; their rows are parted by a hash of all their columns, so a rerun parts them alike, and their row of ``table``,
    whatever its size, is shuffled to each part: no task gets all rows of one key.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(table.drop(count), key)
    parts = F.when(F.col(count) > limit, F.ceil(F.col(count) / limit)).otherwise(1).cast("int")
    hot = table.where(F.col(count) > limit).select(F.col(key).alias("__k"), parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__k"), "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")).cast("int"), F.lit(0))).drop("__k", "__parts")
    copies = table.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(count)
    return dealt.join(copies, [key, "__part"]).select(*rows.columns, *[c for c in table.columns if c not in (key, count)])


def held_out(id_col: str = "doc_id"):
    """The rows that no model may learn labels from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch as UTF-8 bytes (null: empty), in runs of about ``limit`` bytes with the index of their first."""
    values = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield start, values[start:i]
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, values[start:]


#: Codepoint classes: everything else, letters (L*), numbers (N*), white space.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, from the Unicode general categories; built once a worker."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
