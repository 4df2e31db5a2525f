import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadweave.llm import simhash
from roadweave.llm.components import connected_components
from roadweave.llm.queries import op2_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(range(len(fps)))

    def root(i):
        while ids[i] != i:
            i = ids[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                ids[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_query_matches_brute_force(spark):
    rows = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    fps = [brute_fp(t) for _, t in rows]
    want = {(d, f"{fp:016x}", rows[c][0]) for (d, _), fp, c in zip(rows, fps, brute_components(fps), strict=True)}
    got = [tuple(r) for r in op2_simhash_near_dedup(spark, SF).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_pigeonring_keeps_every_near_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    assert np.logical_or.reduce([simhash.pigeonring(a, b, s) for s in range(4)]).all()


@pytest.mark.parametrize("block", [4, 1024])
def test_links_lose_no_component(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 6)
    fps = sorted({int(x) for b in base for x in [b, *(b ^ (1 << rng.integers(0, 62)) ^ (1 << rng.integers(0, 62)) for _ in range(40))]})
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block).collect()
    assert all((r.u ^ r.v).bit_count() <= 3 for r in links)
    want = [fps[i] for i in brute_components(fps)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([tuple(r) for r in links], "u long, v long")).collect()}
    assert [got.get(f, f) for f in fps] == want


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, " \t\n", 5), (3, "a b c d", 5), (3, "a b c d", 6), (None, "a b c d", 7), (4, "x" * 300_000, 8)], "doc_id long, text string, fp int")
    out = sorted(tuple(r) for r in simhash.near_duplicates(df).collect())
    assert [(d, c) for d, _, c, *_ in out] == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    assert out[0][1] == out[1][1] == 0
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 199)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50)) and got[200] == 199


def test_long_text_of_many_words(spark):
    rng = np.random.default_rng(2)
    text = " ".join(f"w{i}" for i in rng.integers(0, 5000, 120_000))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[1].fp % 2**64 == brute_fp(text) and got[2].fp % 2**64 == brute_fp(text + " more") and got[2].component_id == 1


def test_one_of_each_group(spark):
    rows = [(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "q r s t u v", "z"), (3, "q r s t u v", "a"), (3, "other words of one id", "b"), (None, "a b c d e", "c"), (4, None, "d"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.text or "", r.fp) for r in simhash.one_of_each(df).collect())
    assert got == [(1, "a b c d e", "x"), (3, "other words of one id", "b"), (3, "q r s t u v", "a"), (4, "", "d")]
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0


def test_components_with_a_hot_node(spark, monkeypatch):
    from roadweave.llm import components

    monkeypatch.setattr(components, "HOT_ROWS", 5)
    monkeypatch.setattr("roadweave.llm._common.HOT_ROWS", 5)
    edges = [(i, 500) for i in range(100, 160)] + [(i, i + 1) for i in range(20)] + [(20, 159)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 82 and set(got.values()) == {0}
