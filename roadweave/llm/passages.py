"""Passages that stand in several documents, wherever they lie in lines: anchored windows of words, told apart by hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, checkpointed, discard, join_by_hot_key, stored, text_slices

#: Words of a window, and of the grams from which a window's anchor is picked: a third of it.
WINDOW, GRAMS = 50, 3
#: A-Z become a-z; ASCII marks and blanks, line ends too, become blanks.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd bases of the two hashes of a run of words.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class _Runs:
    """Hashes of runs of words by differences of prefix sums: that of words a to b, b excluded, is the sum of h[i] * base ** (i - a)."""

    def __init__(self, words: np.ndarray, base: int):
        self.back = self._powers(pow(base, -1, 2**64), len(words))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self._powers(base, len(words)), dtype=np.uint64)))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.back[a])


def _least(h: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every ``k`` neighbours."""
    size = 1
    while 2 * size <= k:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (k - size)], h[k - size :])


class _Units:
    """The units of a few texts. A unit is a longest run of windows of one text that have one anchor, the smallest hash of a window's grams.

    What a window's anchor is depends on its words alone, so equal windows are in units of one anchor.
    """

    def __init__(self, texts: list[bytes], length: int):
        words = [t.translate(NORMAL).split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(n) - n
        self.text = self.first = self.last = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.uint64)
        if not len(n) or n.max() < length:
            return
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(n.sum()))
        text = np.repeat(np.arange(len(words)), n)
        self.one, self.two = (_Runs(h, base) for base in BASES)
        gram = max(1, length // GRAMS)
        at = np.arange(len(h) - gram + 1)
        anchor = _least(self.one(at, at + gram), length - gram + 1)
        window = np.flatnonzero(text[: len(h) - length + 1] == text[length - 1 :])
        after, before = window[1:], window[:-1]
        new = np.flatnonzero(np.concatenate(([True], (after - before > 1) | (text[after] != text[before]) | (anchor[after] != anchor[before]))))
        self.first = window[new]
        self.last = window[np.append(new[1:], len(window)) - 1]
        self.text, self.anchor = text[self.first], anchor[self.first]


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc, sub, anchor of each unit, and a hash of all its words."""
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                u = _Units(texts, length)
                if len(u.first):
                    at = pa.array(u.text + start)
                    # Repeated words give units of one anchor of any length.
                    unit = u.two(u.first, u.last + length) ^ (u.last - u.first).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(u.anchor.view(np.int64)), pa.array(unit.view(np.int64))], names=["doc", "sub", "anchor", "unit"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc, sub, first word and the one after the last, of the settled units with the smallest document that holds them, of
        the others for each window with a 128-bit hash of its words."""
        for batch in batches:
            asked = batch.column(3)
            end, flat = asked.offsets.to_numpy(), asked.values
            anchors, settled = flat.field("anchor").to_numpy().view(np.uint64), flat.field("settled").to_numpy(zero_copy_only=False)
            least = flat.field("lo")
            for start, texts in text_slices(batch.column(2)):
                u = _Units(texts, length)
                bounds = np.searchsorted(u.text, np.arange(len(texts) + 1))
                place = np.full(len(u.first), -1)
                for i in range(len(texts)):
                    lo, hi = int(end[start + i]), int(end[start + i + 1])
                    order = np.argsort(anchors[lo:hi])
                    mine, known = u.anchor[bounds[i] : bounds[i + 1]], anchors[lo:hi][order]
                    k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    place[bounds[i] : bounds[i + 1]] = np.where(known[k] == mine, lo + order[k], -1)

                def rows(text: np.ndarray, first: np.ndarray, last: np.ndarray, lo: pa.Array, h: pa.Array, batch=batch, start=start, u=u) -> pa.RecordBatch:
                    at = pa.array(text + start)
                    return pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(first - u.begin[text]), pa.array(last + length - u.begin[text]), lo, h], names=["doc", "sub", "s", "e", "lo", "h"]
                    )

                done = np.flatnonzero((place >= 0) & settled[place]) if len(settled) else np.empty(0, np.int64)
                if len(done):
                    yield rows(u.text[done], u.first[done], u.last[done], least.take(pa.array(place[done])), pa.nulls(len(done), pa.binary()))
                left = np.flatnonzero((place >= 0) & ~settled[place]) if len(settled) else np.empty(0, np.int64)
                if len(left):
                    n = u.last[left] - u.first[left] + 1
                    w = np.repeat(u.first[left] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.stack((u.one(w, w + length), u.two(w, w + length)), axis=1)
                    h = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(np.arange(0, 16 * len(w) + 1, 16, dtype=np.int32)), pa.py_buffer(both)])
                    yield rows(np.repeat(u.text[left], n), w, w, pa.nulls(len(w), least.type), h)

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """A row for each passage of a document that others hold too: id, first_word (from 0), n_words, n_removed (those of its words in
    windows that a document of smaller id holds) and the first such document's id, its own if there is none.

    A window is ``length`` words in a row, whatever lines they are in; words are runs of letters, digits and whatever is beyond
    ASCII, A-Z lower-cased. A passage is a longest run of words of which every one is in a window that a document of another id
    holds too. Shorter runs, lines that recur say, are none, nor is what only one document repeats. Null and shorter texts
    give no row; rows without id are left out; rows that repeat an id and text count once, rows of one id with different texts
    give rows of their own; an empty table gives none; other columns play no part.

    Exact but for chance collisions of 128 bits of hash. A text sends a row for each anchor, one in some 18 words; texts are
    shuffled once, to those of their anchors that several documents hold. Where all units of an anchor are equal, they are a row
    each from then on; only windows of anchors with unlike units are met one by one. No task gets all rows of one anchor or window.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("sub"), F.col(text_col).cast("binary").alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    kind = docs.schema["doc"].dataType
    units = stored(docs.mapInArrow(_find(length), f"doc {kind.simpleString()}, sub long, anchor long, unit long"))
    of_anchor = units.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"), (F.min("unit") == F.max("unit")).alias("settled"))
    shared = checkpointed(of_anchor.where("lo <> hi").select("anchor", "n", "settled", F.when(F.col("settled"), F.col("lo")).alias("lo")))
    asked = join_by_hot_key(units.select("doc", "sub", "anchor"), shared, "anchor", "n").groupBy("doc", "sub").agg(F.collect_set(F.struct("anchor", "settled", "lo")).alias("asked"))
    found = stored(docs.join(asked, ["doc", "sub"]).select("doc", "sub", "text", "asked").mapInArrow(_cut(length), f"doc {kind.simpleString()}, sub long, s long, e long, lo {kind.simpleString()}, h binary"))
    discard(units)

    left = found.where("h IS NOT NULL").drop("lo")
    met = checkpointed(left.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo <> hi").drop("hi"))
    hits = found.where("h IS NULL").drop("h").union(join_by_hot_key(left, met, "h", "n").select("doc", "sub", "s", "e", "lo"))

    # Stretches that meet or overlap are one passage.
    by = Window.partitionBy("doc", "sub").orderBy("s", "e")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    later = F.when(F.col("lo") < F.col("doc"), F.col("e"))
    marked = hits.select("*", F.coalesce(F.max("e").over(before), F.lit(-1)).alias("end"), F.coalesce(F.max(later).over(before), F.lit(0)).alias("gone"))
    runs = marked.withColumn("run", F.sum((F.col("s") > F.col("end")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    gone = F.when(later.isNotNull(), F.greatest(F.lit(0), F.col("e") - F.greatest("s", "gone"))).otherwise(0)
    out = runs.groupBy("doc", "sub", "run").agg(F.min("s").alias("first_word"), (F.max("e") - F.min("s")).alias("n_words"), F.sum(gone).alias("n_removed"), F.min("lo").alias("first_doc_id"))
    return out.select(F.col("doc").alias(id_col), "first_word", "n_words", "n_removed", "first_doc_id")


#: All windows, spelled out.
SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS text_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
),
windows AS MATERIALIZED (SELECT text_no, doc_id, p - 1 AS s, array_to_string(w[p : p + 49], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
met AS MATERIALIZED (SELECT t, min(doc_id) AS lo FROM windows GROUP BY t HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT text_no, doc_id, s, lo FROM windows JOIN met USING (t)),
marked AS (
  SELECT *, s > coalesce(lag(s) OVER (PARTITION BY text_no ORDER BY s) + 50, -1) AS fresh,
    max(CASE WHEN lo < doc_id THEN s + 50 END) OVER (PARTITION BY text_no ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone
  FROM hits
),
runs AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY text_no ORDER BY s) AS run FROM marked)
SELECT doc_id, min(s)::BIGINT AS first_word, (max(s) + 50 - min(s))::BIGINT AS n_words,
  sum(CASE WHEN lo < doc_id THEN s + 50 - greatest(s, coalesce(gone, 0)) ELSE 0 END)::BIGINT AS n_removed, min(lo) AS first_doc_id
FROM runs GROUP BY text_no, doc_id, run
"""
