"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, checkpointed, join_by_hot_key, text_slices
from .components import connected_components

#: Hash seed, words a shingle, bits that may differ.
SEED, SHINGLE, DISTANCE = 42, 3, 3
SEGMENTS, WIDTH = 4, 16
#: Distinct fingerprints compared at once within one bucket.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``df`` and ``out``, the 64-bit SimHash as a signed long. Null and blank texts have 0.

    A clashing column named ``out`` is replaced.
    """
    bounded_batches(df.sparkSession)
    df = df.drop(out)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for _, texts in text_slices(batch.column(at)) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*kinds, f"`{out}` long"]))


def _segments(fp: np.ndarray) -> np.ndarray:
    return np.stack([(fp >> np.uint64(WIDTH * i)) & np.uint64(0xFFFF) for i in range(SEGMENTS)])


def pigeonring(a: np.ndarray, b: np.ndarray, start: int, distance: int = DISTANCE) -> np.ndarray:
    """Whether the chain of segments from ``start`` (a ring) keeps every prefix sum of differing bits within its share of ``distance``.

    If two fingerprints differ in at most ``distance`` bits, such a start exists; so pairs that fail from every start
    need no full check.
    """
    x = a ^ b
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for n in range(1, SEGMENTS + 1):
        seg = (x >> np.uint64(WIDTH * ((start + n - 1) % SEGMENTS))) & np.uint64(0xFFFF)
        total += np.bitwise_count(seg)
        ok &= total * SEGMENTS <= n * distance
    return ok


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and ring start: the first two segments as they are (index), and with each single bit of the second flipped (probe)."""
    flips = np.concatenate(([0], 1 << np.arange(WIDTH, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fp), 4096):
            part = fp[i : i + 4096]
            seg = _segments(part)
            for s in range(SEGMENTS):
                first, second = seg[s], seg[(s + 1) % SEGMENTS]
                key = (np.uint64(s) << np.uint64(32)) | (first << np.uint64(16)) | second
                keys = (key[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.tile(np.arange(len(flips)) == 0, len(part)))], names=["key", "fp", "own"])


def _forest(index: np.ndarray, probe: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Links that span what the full check joins: a sorted index block against a probe block, at most one a member.

    A label stands for what is known to hang together within the block; a probe that is near to several labels merges them.
    """
    label = np.arange(len(index))
    at = np.searchsorted(index, probe).clip(max=len(index) - 1)
    inside = index[at] == probe
    us: list[int] = []
    vs: list[int] = []
    for i in range(0, len(probe), 256):
        p = probe[i : i + 256]
        n = np.bitwise_count(p[:, None] ^ index[None, :])
        r, c = np.nonzero((n <= DISTANCE) & (n > 0))
        ok = pigeonring(p[r], index[c], start)
        r, c = r[ok], c[ok]
        for q in np.unique(r).tolist():
            near = c[np.searchsorted(r, q) : np.searchsorted(r, q, "right")]
            labels, first = np.unique(label[near], return_index=True)
            old = label[at[i + q]] if inside[i + q] else -1
            new = labels != old
            us += [int(p[q])] * int(new.sum())
            vs += index[near[first[new]]].tolist()
            if new.sum() + (old >= 0) > 1:
                every = np.append(labels, old) if old >= 0 else labels
                label[np.isin(label, every)] = every[0]
    return us, vs


def _links_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, block); a group is held as its fingerprints only and has at most two blocks of them."""
    hold: list[tuple[np.ndarray, ...]] = []

    def flush(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, pair, fp, own = cols
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
        stop = np.concatenate((edge[1:], [len(key)]))
        us: list[int] = []
        vs: list[int] = []
        for a, b in zip(edge[stop - edge > 1].tolist(), stop[stop - edge > 1].tolist(), strict=True):
            mine = own[a:b]
            if mine.any() and len(np.unique(fp[a:b])) > 1:
                u, v = _forest(np.unique(fp[a:b][mine]), np.unique(fp[a:b]), int(key[a] >> 32))
                us += u
                vs += v
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.uint64).view(np.int64)), pa.array(np.array(vs, np.uint64).view(np.int64))], names=["u", "v"])

    for batch in batches:
        hold.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
        key, pair, fp, own = (np.concatenate(x) for x in zip(*hold, strict=True))
        fp = fp.view(np.uint64)
        last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from flush((key[:cut], pair[:cut], fp[:cut], own[:cut]))
        hold = [(key[cut:], pair[cut:], fp[cut:].view(np.int64), own[cut:])]
    if hold and len(hold[0][0]):
        key, pair, fp, own = hold[0]
        yield from flush((key, pair, fp.view(np.uint64), own))


def near_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose components are those of "differ in at most 3 bits".

    Pigeonring with four segments of 16 bits: near fingerprints have a ring start whose first segment is equal and whose
    first two differ in one bit at most, so they meet under a 33-bit key; the rest of the chain and the full distance are
    checked within the bucket. Buckets are counted first (a partial aggregate); those of one fingerprint are dropped
    before anything is gathered. A bucket above ``block`` fingerprints is dealt out as pairs of blocks, so a task
    never holds more than two blocks of one bucket. Only links that span a block pair are returned.
    """
    spark = fps.sparkSession
    bounded_batches(spark)
    keys = fps.select("fp").mapInArrow(_keys, "key long, fp long, own boolean")
    counts = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).where("n > 1 AND any_own")
    rows = join_by_hot_key(keys, checkpointed(counts.select("key", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks"))), "key", "n")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Pair i * blocks + j holds index block i and probe block j; every row is a probe, an index row is both.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_index = rows.where("own OR blocks = 1").select("key", "fp", "own", F.explode(F.transform(every, lambda j: F.col("mine") * F.col("blocks") + j)).alias("pair"))
    as_probe = rows.where("blocks > 1").select("key", "fp", F.lit(False).alias("own"), F.explode(F.transform(every, lambda i: i * F.col("blocks") + F.col("mine"))).alias("pair"))
    dealt = as_index.union(as_probe).select("key", "pair", "fp", "own")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links_in_buckets, "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df`` with an id: id, fp (signed long), component_id, the smallest id reachable over links,
    text_hash, and group, a fingerprint that names the component.

    Equal fingerprints are one node from the start, so exact copies cost no pairs; blank and null texts share
    fingerprint 0 and are linked like any other. Rows without id are left out; repeated rows give repeated rows, and texts
    of one id may lie in different components; an empty table gives none. Other columns of ``df`` play no part.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash")).where("id IS NOT NULL")
    prints = checkpointed(fingerprints(own).select("id", "text_hash", "fp"))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    parts = connected_components(near_links(nodes))
    merged = checkpointed(nodes.join(parts.withColumnRenamed("node", "fp"), "fp"))
    # The smallest id of each component; a component that is one fingerprint needs no such step.
    best = checkpointed(merged.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("fps")))
    found = join_by_hot_key(merged.select("fp", "component"), best, "component", "fps")
    ids = checkpointed(nodes.join(found, "fp", "left").select("fp", "n", F.coalesce("best", "least").alias("component_id"), F.coalesce("component", "fp").alias("group")))
    return join_by_hot_key(prints, ids, "fp", "n").select(F.col("id").alias(id_col), "fp", "component_id", "text_hash", "group")


def text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay when one of each group of near copies does: that of smallest id, then text hash, then row as JSON.

    Rows without id go; texts of one id that are not near copies stay; all columns are kept.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # so that no column clashes with those that follow
    own, text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    groups = near_duplicates(plain.select(F.col(own).alias("doc"), F.col(text).alias("text")), "doc")
    first = groups.groupBy("group").agg(F.min(F.struct("doc", "text_hash")).alias("k")).select("k.doc", F.col("k.text_hash").alias("hash")).distinct()
    rows = plain.join(first, (F.col(own) == F.col("doc")) & (text_hash(text) == F.col("hash")), "left_semi")
    repeated = plain.where(F.col(own).isNotNull()).groupBy(own).count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        order = Window.partitionBy(own, text_hash(text)).orderBy(F.to_json(F.struct(*[c for c in plain.columns if c != text])))
        rows = rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return rows.toDF(*df.columns)
