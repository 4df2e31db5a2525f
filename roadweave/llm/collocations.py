"""Phrase collocations by word-id suffix arrays of shards, whose LCP intervals give n-gram counts that are merged by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, stored

#: Bytes of text of a shard, about, and words whose pairs one bucket of the merge holds, about.
SHARD_BYTES, BUCKET_WORDS = 1 << 23, 1 << 22
#: Words of a phrase at most.
LONGEST = 4
#: A-Z become lower case, what ends a piece becomes a full stop, and tabs become spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def _cuts(text: bytes, limit: int) -> Iterator[bytes]:
    """A plain text in parts of about ``limit`` bytes, cut where pieces end; a longer piece stays whole."""
    at = 0
    while len(text) - at > limit:
        cut = text.rfind(b".", at, at + limit)
        cut = text.find(b".", at + limit) if cut < 0 else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ids from 1 of the words of a plain text, 0 where a piece ends, and the words by id less 1."""
    codes, words = pd.factorize(np.array([b".", *text.replace(b".", b" . ").split()], object))
    return codes.astype(np.int32), list(words[1:])  # the stop comes first, so its code is 0


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, lang, n_words, ids (32-bit integers) and words (space-joined), both compressed: all texts, some megabytes of one language a row; stored."""

    def row(lang: str, parts: list[bytes]) -> tuple:
        ids, words = word_ids(b".".join(parts))
        return lang, int(np.count_nonzero(ids)), zstandard.compress(ids.tobytes()), zstandard.compress(b" ".join(words))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "n_words", "ids", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                for part in _cuts((text or b"").translate(_PLAIN), shard_bytes):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= shard_bytes:
                        yield batch([row(lang, held.pop(lang))])
                        del size[lang]
                    elif sum(size.values()) >= 2 * shard_bytes:  # many languages: the largest goes
                        most = max(size, key=lambda k: size[k])
                        yield batch([row(most, held.pop(most))])
                        del size[most]
        for lang, parts in held.items():
            yield batch([row(lang, parts)])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "lang string, n_words long, ids binary, words binary").where("n_words > 0")
    return stored(out.withColumn("shard", F.monotonically_increasing_id()), **{"parquet.block.size": str(4 * shard_bytes)})


def _opened(ids: bytes, words: bytes) -> tuple[np.ndarray, list[bytes]]:
    return np.frombuffer(zstandard.decompress(ids), np.int32), zstandard.decompress(words).split(b" ")


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``ids`` in the order of their first ``depth`` words (a power of two), and each one's LCP with the one before, at most that.

    Prefix doubling: ranks by the first 2k words are ranks of pairs of ranks by k words.
    """
    rank = ids.astype(np.int64)
    known = 1
    while known < depth:
        behind = np.zeros_like(rank)
        behind[:-known] = rank[known:] + 1
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + behind, return_inverse=True)[1].ravel()
        known *= 2
    order = np.argsort(rank, kind="stable")
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    lcp, same = np.zeros(len(ids), np.int8), np.ones(max(len(ids) - 1, 0), bool)
    for k in range(depth):
        same &= padded[order[1:] + k] == padded[order[:-1] + k]
        lcp[1:] += same
    return order, lcp


def ngrams(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of every n-gram within a piece, and how often it stands: the LCP intervals of n words, without those that cross a piece's end."""
    first = np.flatnonzero(lcp < n)
    count = np.diff(np.append(first, len(order)))
    at = order[first]
    inside = at + n <= len(ids)
    at, count = at[inside], count[inside]
    inside = np.ones(len(at), bool)
    for k in range(n):
        inside &= ids[at + k] > 0
    return at[inside], count[inside]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Keys:
    """96-bit keys, of a low half and 32 high bits, of pairs of a shard's words, equal in all shards of a language."""

    LANES = ("roadweave:lane:0", "roadweave:lane:1")

    def __init__(self, lang: str, words: list[bytes]) -> None:
        table = np.array([lang.encode(), *words], object)
        lanes = [pd.util.hash_array(table, hash_key=k, categorize=False) for k in self.LANES]
        self.lanes = [_mixed(h + _mixed(h[:1])) for h in lanes]  # word id i at i

    def of(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        low, high = (_mixed(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b]) for h in self.lanes)
        return [low, high.astype(np.uint32)]


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids, words = _opened(r["ids"], r["words"])
            n = np.bincount(ids, minlength=len(words) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(n)], names=["lang", "phrase", "f"])


def _pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """shard, bucket, low, high, n: the keys of a shard's pairs of words and how often they stand, by the keys' bucket."""
    for b in batches:
        for r in b.to_pylist():
            ids, words = _opened(r["ids"], r["words"])
            at, n = ngrams(ids, *suffix_array(ids, 2), 2)
            low, high = _Keys(r["lang"], words).of(ids[at], ids[at + 1])
            order = np.argsort(low)
            low, high, n = low[order], high[order], n[order].astype(np.uint32)
            bucket = (low >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            parts = [[x[cut[i] : cut[i + 1]].tobytes() for i in full] for x in (low, high, n)]
            yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(full), pa.int64()), pa.array(full.astype(np.int32)), *[pa.array(p, pa.binary()) for p in parts]], names=["shard", "bucket", "low", "high", "n"])


def _merged(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """For each shard of a bucket's rows those of its pairs that stand ``least`` times in all: keys, counts, and whether it is the first shard with the pair."""
    pdf = pdf.sort_values("shard")
    low, high, n = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("low", np.uint64), ("high", np.uint32), ("n", np.uint32)))
    shard = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["low"]])
    order = np.argsort(low, kind="stable")
    if ((low[order][1:] == low[order][:-1]) & (high[order][1:] != high[order][:-1])).any():
        order = np.lexsort((shard, high, low))
    low, high, n, shard = low[order], high[order], n[order].astype(np.int64), shard[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    start = np.flatnonzero(new)
    total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(low)))) if len(low) else n
    keep = np.flatnonzero(total >= least)
    keep = keep[np.argsort(shard[keep], kind="stable")]
    mine, cut = np.unique(shard[keep], return_index=True)
    columns = {"low": low, "high": high, "n": total, "first": new}
    parts = {k: [p.tobytes() for p in np.split(v[keep], cut[1:])] if len(keep) else [] for k, v in columns.items()}
    return pd.DataFrame({"shard": pdf["shard"].to_numpy()[mine], **parts})


def _phrases(ids: np.ndarray, words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = words[ids[at] - 1]
    for k in range(1, n):
        out = out + b" " + words[ids[at + k] - 1]
    return out


def _longer(shard: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
    """lang, phrase, f: the frequent pairs that this shard is the first to have, with their counts; and its own counts of longer phrases all of whose pairs are frequent."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if len(shard) and len(frequent):
        r = shard.iloc[0]
        ids, words = _opened(r["ids"], r["words"])
        keys, words = _Keys(r["lang"], words), np.array(words, object)
        low, high, n, first = (np.frombuffer(b"".join(frequent[c]), t) for c, t in (("low", np.uint64), ("high", np.uint32), ("n", np.int64), ("first", bool)))
        order = np.lexsort((high, low))
        low, high, n, first = low[order], high[order], n[order], first[order]
        pair, of = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        mine_low, mine_high = keys.of(a, b)
        found = np.searchsorted(low, mine_low)
        while True:  # of keys with one low half, on to the one with the same high half
            at = np.minimum(found, len(low) - 1)
            on = (found < len(low)) & (low[at] == mine_low) & (high[at] < mine_high)
            if not on.any():
                break
            found = found + on
        known = (low[at] == mine_low) & (high[at] == mine_high) & (a > 0) & (b > 0)
        own = np.flatnonzero(known & first[at])
        out.append((words[a[own] - 1] + b" " + words[b[own] - 1], n[at[own]]))
        joins = np.append(known[of.ravel()], False)  # the word and the next are a frequent pair
        kept = np.flatnonzero(joins | np.append(False, joins[:-1]))
        width = 2 - joins[kept]  # a run's last word is followed by an end
        runs = np.zeros(int(width.sum()), np.int32)
        runs[np.cumsum(width) - width] = ids[kept]
        order, lcp = suffix_array(runs, LONGEST)
        for k in range(3, LONGEST + 1):
            at, count = ngrams(runs, order, lcp, k)
            out.append((_phrases(runs, words, at, k), count.astype(np.int64)))
    phrase, f = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [])
    lang = shard.iloc[0]["lang"].encode() if len(phrase) else b""
    return pd.DataFrame({"lang": [lang] * len(phrase), "phrase": phrase, "f": np.array(f, np.int64)})


def phrase_counts(sharded: DataFrame, least: int = 30) -> DataFrame:
    """lang, phrase, k (its words, 1 to 4), f: every phrase that stands ``least`` times or more in its language's texts, with its count; stored.

    Pairs of words are counted first. Each shard's suffix array gives its pairs' keys and counts, which meet by buckets of
    keys; each shard hears which of its pairs are frequent, and its suffix array over the runs of these gives the
    longer phrases, as a frequent phrase has only frequent pairs. So only pairs are sent from all texts, a key of 96 bits
    once a shard, and a pair that is everywhere costs its bucket a key a shard. Counts are exact but for chance collisions of keys.
    """
    spark = sharded.sparkSession
    total = sharded.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WORDS))
    slim = sharded.select("shard", "lang", "ids", "words")
    pairs = slim.mapInArrow(lambda it: _pairs(it, buckets), "shard long, bucket int, low binary, high binary, n binary")
    frequent = pairs.groupBy("bucket").applyInPandas(lambda pdf: _merged(pdf.drop(columns="bucket"), least), "shard long, low binary, high binary, n binary, first binary")
    longer = slim.groupBy("shard").cogroup(frequent.groupBy("shard")).applyInPandas(_longer, "lang binary, phrase binary, f long").withColumn("lang", F.col("lang").cast("string"))
    single = slim.mapInArrow(_unigrams, "lang string, phrase binary, f long")
    counts = single.union(longer).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrase = F.col("phrase").cast("string")
    return stored(counts.select("lang", phrase.alias("phrase"), (F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1).alias("k"), "f"))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)) in decimals, as the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r)).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, inside_percent: int = 80, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 4 words whose parts mostly stand together.

    Texts (null: empty) are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and these into words at spaces and tabs. a is a
    phrase's count, l and r are those of its first k and its other words, n is the language's words, and the score is
    floor(2000000 a / (l + r)) at the cut where that is least (ties: the smallest k). Phrases of fewer than ``least``
    occurrences are none; those that lie inside a longer one with at least ``inside_percent`` of their count are dropped. Order: by score, then
    a, then phrase in byte order. A null language is und; repeated rows count as often as they stand; no words give no rows.
    """
    sharded = shards(docs, text_col, lang_col, shard_bytes)
    counts = phrase_counts(sharded, least)
    words = stored(sharded.groupBy("lang").agg(F.sum("n_words").alias("n")))
    discard(sharded)
    whole = counts.where("k > 1")
    cut = whole.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    head, tail = (counts.select("lang", F.col("phrase").alias(p), F.col("f").alias(f)) for p, f in (("head", "l"), ("tail", "r")))
    scored = cut.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    split = F.split("phrase", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(split, i, m), " "))))
    inner = counts.where("k > 2").select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a"))).drop("longer")
    # First the best of each share of a language's phrases, then the best of these.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(x) - k + 2), lambda i: array_to_string(x[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
),
n AS (SELECT lang, sum(len(x)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x, unnest(range(1, k)) AS cut FROM f WHERE k > 1
),
s AS (
  SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(x[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(x[cut + 1:], ' ')
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (
  SELECT b.* FROM b WHERE NOT EXISTS (
    SELECT 1 FROM f WHERE f.lang = b.lang AND f.k > b.k AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * f.f >= 80 * b.a)
)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score
FROM d JOIN n USING (lang) QUALIFY rank <= 2000
"""
