import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard

from roadweave.llm import collocations as col
from roadweave.llm.queries import op11_phrase_collocations

SF = "/root/testdata/sf0.01"


def brute(rows, least, top=2000):
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    good = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    for (lang, p), a in good.items():
        if any(lo == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lo, q), b in good.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))  # noqa: E741
        out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out.sort()
    rank = Counter()
    got = []
    for lang, s, a, p, l, r in out:  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -s))
    return sorted(got)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "\U0001f600", "￿", "\x00", "x y", "a-b"]
    said = lambda k: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for _ in range(k))
    rows = [(rng.choice(["en", "de", None, "und"]), said(rng.choice([0, 1, 3, 30, 80]))) for _ in range(120)]
    return rows + [("en", None), ("en", ""), ("en", "..,\n"), ("fr", "one two three four five " * 40), ("en", said(3000)), *[("en", "the cat sat on the mat")] * 60, ("zz", "never twice here")]


@pytest.mark.parametrize("seed,shard_bytes,least,top", [(1, 1 << 23, 8, 2000), (2, 200, 5, 7), (3, 1500, 2, 2000)])
def test_matches_brute_force(spark, seed, shard_bytes, least, top):
    rows = texts(seed)
    df = spark.createDataFrame([(a, b, "p", 1, 2) for a, b in rows], "lang string, text string, phrase string, shard int, f int").repartition(3)
    got = col.collocations(df, least=least, top=top, shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 5, 3000).astype(np.int32)
    order, lcp = col.suffix_array(ids, 4)
    head = lambda i: tuple([*ids[i : i + 4].tolist(), -1, -1, -1, -1][:4])
    assert sorted(order) == list(range(3000)) and [head(i) for i in order] == sorted(map(head, range(3000)))
    for n in range(1, 5):
        want = Counter(tuple(ids[i : i + n].tolist()) for i in range(3000 - n + 1) if (ids[i : i + n] > 0).all())
        at, count = col.ngrams(ids, order, lcp, n)
        assert {tuple(ids[i : i + n].tolist()): c for i, c in zip(at, count, strict=True)} == want
    assert len(col.suffix_array(np.zeros(0, np.int32), 4)[0]) == 0


def test_halves_of_keys_may_collide(monkeypatch, spark):
    """With only a few low halves the high halves tell pairs apart."""
    of = col._Keys.of
    monkeypatch.setattr(col._Keys, "of", lambda self, a, b: [of(self, a, b)[0] >> np.uint64(61) << np.uint64(61), of(self, a, b)[1]])
    ids, words = col.word_ids(b"a b c d a b c d a c b d. a b. c d. b a d c")
    shard = {"shard": 5, "lang": "en", "ids": zstandard.compress(ids.tobytes()), "words": zstandard.compress(b" ".join(words))}

    batch = pa.RecordBatch.from_pylist([shard])
    (pairs,) = col._pairs(iter([batch]), 1)
    found = col._merged(pairs.to_pandas().drop(columns="bucket"), 2)
    out = col._longer(pd.DataFrame([shard]), found)
    assert {k: v for k, v in zip(out["phrase"], out["f"], strict=True) if k.count(b" ") == 1} == {b"a b": 3, b"b c": 2, b"c d": 3, b"d a": 2}


def test_large_products(spark):
    rows = spark.createDataFrame([(3 * 10**15, 4 * 10**15, 5 * 10**15), (7, 7, 7), (30, 31, 10**17)], "a long, l long, r long")
    got = [r.s for r in rows.select(col._score(rows.a, rows.l, rows.r).alias("s")).collect()]
    assert got == [2_000_000 * a // (l + r) for a, l, r in ((3 * 10**15, 4 * 10**15, 5 * 10**15), (7, 7, 7), (30, 31, 10**17))]


def test_empty(spark):
    assert col.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert col.collocations(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = op11_phrase_collocations(spark, SF)
    assert [t for c, t in got.dtypes if c not in ("lang", "phrase")] == ["bigint"] * 6
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(col.SQL).fetchall())
