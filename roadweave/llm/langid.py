"""Language identification by a bit-sliced Bloom filter: one look-up gives the mask of all languages that have an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import LETTER, bounded_batches, checkpointed, codepoint_classes, codepoints, text_slices

#: n-gram lengths over lower-cased letters, a blank standing for whatever is between words.
ORDERS = (3, 4)
#: Labelled texts learned from, a language, at most (by the ids' hash, about as many if there are more): the one bounded sample.
DOCS_PER_LANGUAGE = 3000
#: An n-gram is held by the languages with at least this share of its highest rate.
SHARE = 0.5
#: Rows of the filter: a power of two, this or as many as give every n-gram of the largest language SLACK rows; and looked-up rows an n-gram.
ROWS, SLACK, HASHES = 1 << 16, 16, 2
UNDETERMINED = "und"


def ngrams(texts: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the hash at every position, whether an n-gram stands there, and where each text starts.

    An n-gram's inner codepoints are letters and its ends letters or a blank, but not both ends of a single letter's word.
    """
    lowered = [t.lower() for t in texts]
    joined = codepoints("  " + "  ".join(lowered) + "  ")
    starts = np.cumsum([0, *(len(t) + 2 for t in lowered[:-1])])
    letter = codepoint_classes()[joined] == LETTER
    cp = np.where(letter, joined, 32).astype(np.uint64)
    for n in orders:
        size = len(cp) - n + 1
        h = np.full(size, n, np.uint64)
        ok = np.ones(size, bool)
        for i in range(n):
            h = (h ^ cp[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if 0 < i < n - 1:
                ok &= letter[i : i + size]
        yield h, ok, np.minimum(starts, size - 1)


def _slots(h: np.ndarray, rows: int, hashes: int) -> Iterator[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(hashes):
        yield ((a + np.uint64(k) * b) & np.uint64(rows - 1)).astype(np.intp)


@dataclass
class Model:
    """``masks``: for each row, one bit a language, in words of 64; ``wrong``: each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray
    orders: tuple[int, ...] = ORDERS
    hashes: int = HASHES

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray], orders: tuple[int, ...] = ORDERS, rows: int = ROWS, hashes: int = HASHES) -> Model:
        languages = sorted(profiles)
        rows = max(rows, 1 << (SLACK * max(map(len, profiles.values()), default=0)).bit_length())
        masks = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
        for i, lang in enumerate(languages):
            for slot in _slots(profiles[lang].view(np.uint64), rows, hashes):
                masks[slot, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = np.array([np.mean(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(languages))])
        return cls(languages, masks, fill**hashes, orders, hashes)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: n-grams, and for each language those that it holds, less the expected false positives."""
        total, held = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for h, ok, starts in ngrams(texts, self.orders):
            at = np.flatnonzero(ok)
            masks = None
            for slot in _slots(h[at], len(self.masks), self.hashes):
                masks = self.masks[slot] if masks is None else masks & self.masks[slot]
            edges = np.append(np.searchsorted(at, starts), len(at))
            total += np.diff(edges)
            for i in range(len(self.languages)):
                bits = (masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
                held[:, i] += np.diff(np.concatenate(([0], np.cumsum(bits)))[edges])
        return total, np.maximum(0, held - total[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.99))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with the most n-grams (ties: the first by name) and its share of them; und and 0 without a letter."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total, held = self.counts(texts)
        best = held.argmax(axis=1)
        score = np.clip(held[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        some = [total[i] > 0 or any(codepoint_classes()[codepoints(t)] == LETTER) for i, t in enumerate(texts)]
        return [self.languages[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], np.where(some, score, 0)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learns from rows with text, language and id; of languages with over ``per_language`` rows, those with the lowest share of id hashes.

    That parameter bounds the sample, and so its n-grams, of which all that a language has at SHARE of the highest rate or
    more come to the driver. The texts are read once. No row gives a model without languages, which answers und.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id IS NOT NULL AND lang IS NOT NULL")
    # Texts play no part in the sizes, so they are not read for them.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model.of({}, orders)
    limit = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < limit[F.col("lang")] * 1_000_000).where("text IS NOT NULL").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for start, texts in text_slices(batch.column(0)):
                mine = langs[start : start + len(texts)]
                for lang in sorted(set(mine)):
                    for n, (h, ok, _) in zip(orders, ngrams([t.decode("utf-8", "replace") for t, x in zip(texts, mine, strict=True) if x == lang], orders), strict=True):
                        grams, times = np.unique(h[ok], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), pa.array(grams.view(np.int64)), pa.array(times)], names=["lang", "n", "gram", "times"])

    counts = checkpointed(sample.mapInArrow(count, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")))
    totals = counts.groupBy("lang", "n").agg(F.sum("times").alias("total"))  # a row a language and length
    rates = counts.join(F.broadcast(totals), ["lang", "n"]).withColumn("rate", F.col("times") / F.col("total"))
    held = rates.withColumn("top", F.max("rate").over(Window.partitionBy("n", "gram"))).where(F.col("rate") >= F.col("top") * SHARE)
    got = held.select("lang", "gram").toArrow()
    of, grams = np.array(got["lang"].to_pylist(), object), got["gram"].to_numpy()
    return Model.of({lang: grams[of == lang] for lang in sizes}, orders)


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then lang_pred string and score double (0 to 1).

    Null texts and texts without a letter get und and 0; whole texts count, in slices of bounded size; ties go to the
    language first by name. Repeated rows give repeated rows; an empty table gives none; clashing columns are replaced.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of rows of 8 bytes for every 64 languages
    df = df.drop("lang_pred", "score")
    at, names = df.columns.index(text_col), df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for _, texts in text_slices(batch.column(at)):
                found, score = shared.value.predict([t.decode("utf-8", "replace") for t in texts])
                langs += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*names, "lang_pred", "score"])

    return df.mapInArrow(run, f"{kinds}, lang_pred string, score double")
