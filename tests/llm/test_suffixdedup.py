import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import suffix_array as sa
from roadweave.llm import suffixdedup
from roadweave.llm.queries import op6_suffix_array_dedup

SF = "/root/testdata/sf0.001"


def brute(docs):
    """{doc: (bytes, removed, spans, hash of the rest)}"""
    seen, out = set(), {}
    for d, text in sorted(docs.items()):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 99):
            if (s := t[i : i + 100]) in seen:
                gone[i : i + 100] = True
            seen.add(s)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[d] = (len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize("small", [512, 0])
def test_suffix_array_and_prefixes(small, monkeypatch):
    monkeypatch.setattr(sa, "SMALL", small)
    rng = random.Random(small)
    for _ in range(200):
        t = [rng.randrange(1, rng.choice([2, 3, 200])) for _ in range(rng.randrange(0, 120))]
        t = (t * rng.randrange(1, 4))[:300]
        data = np.array([*t, 0], np.uint16)
        want = sorted(range(len(data)), key=lambda i: data[i:].tolist())
        got = sa.suffix_array(data, 257)
        assert got.tolist() == want
        prefix = sa.permuted_prefixes(data.astype(np.uint8), got, 20)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < 20 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert prefix[b] == n


def test_anchors_and_parts():
    """Each string has one anchor, its leftmost smallest gram; equal bytes have equal parts, others differ."""
    rng = random.Random(8)
    for text in ("a" * 400, "ab" * 200, "".join(rng.choice("abc ") for _ in range(3000)), ("x" * 150 + "some other words, and more of them; " * 3) * 4):
        data = np.frombuffer(text.encode(), np.uint8)
        at, _, lo, hi = suffixdedup.anchors(data, np.arange(len(data)) < len(data) - 99)
        grams = suffixdedup._grams(data)
        assert sorted(p for x, y in zip(lo, hi) for p in range(x, y + 1)) == list(range(len(data) - 99))
        assert all(p + int(grams[p : p + 69].argmin()) == i for i, x, y in zip(at, lo, hi) for p in range(x, y + 1))
        moved = suffixdedup._parts(np.concatenate([np.frombuffer(b"zz" * 77, np.uint8), data]), at + 154, lo + 154, hi + 154)
        assert (moved == suffixdedup._parts(data, at, lo, hi)).all()
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(20_000)), np.uint8)
    at, _, lo, hi = suffixdedup.anchors(data, np.arange(len(data)) < len(data) - 99)
    parts = suffixdedup._parts(data, at, lo, hi)
    assert suffixdedup._sharing(np.zeros(len(parts), np.int64), parts).mean() < 0.01


def test_query_matches_brute_force(spark):
    docs = dict(duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: tuple(r)[1:] for r in op6_suffix_array_dedup(spark, SF).collect()}
    assert got == brute(docs) and sum(v[1] for v in got.values())


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 80))) for _ in range(8)]
    docs = {i: " ".join(rng.choice([rng.choice(passages), word(), " ".join(word() for _ in range(20))]) for _ in range(rng.randrange(0, 12))) for i in range(60)}
    common = "the common gram of thirty-two bytes."
    docs |= {100 + i: " ".join(word() for _ in range(12)) + common + " ".join(word() for _ in range(12)) for i in range(40)}
    docs |= {150 + i: "tra la " * 90 for i in range(10)}
    docs |= {200: "a" * 5000, 201: "b" * 99, 202: "ab" * 400, 203: "b" * 99, 204: "b" * 100, 205: "b" * 101, 206: "", 207: None, 208: docs[3], 209: docs[100][:-1]}
    return docs


@pytest.mark.parametrize("seed,hot,chunk,shard", [(0, 20_000, 2 << 20, 1 << 20), (1, 3, 2 << 20, 1 << 20), (2, 20_000, 1000, 500)])
def test_made_documents(spark, monkeypatch, seed, hot, chunk, shard):
    docs = made(seed)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", shard)
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, spans string").repartition(3)
    assert result(suffixdedup.remove_repeats(df, hot_units=hot)) == brute(docs)


def test_batches_split_anywhere():
    """Units and anchors that run over batch borders are judged as in one batch."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted((rng.randrange(12), rng.randrange(3), rng.randrange(30), rng.randrange(2), rng.randrange(4) * 256 + 120, 7) for _ in range(300))
    cols = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(6)], names=list("abcdef"))
    run = lambda size, hot: sorted(str(x) for b in suffixdedup._spans_and_requests(hot)(cols(rows[i : i + size]) for i in range(0, len(rows), size)) for x in b.to_pylist())
    assert run(1, 99) == run(7, 99) == run(300, 99) == run(1, 1) == run(2, 1) == run(7, 2)


def test_repeated_rows_null_ids_and_empty(spark):
    text = "some words that go on for more than one hundred bytes, so that there is a string to find in it, and then some"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffixdedup.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]
    assert suffixdedup.remove_repeats(df.where(F.lit(False))).count() == 0


def test_texts_of_one_id(spark):
    a = "some words that go on for more than one hundred bytes, so that there is a string to find in it, and then some"
    b = "quite other words which go on for more than one hundred bytes as well, so that nothing of the first is in here"
    df = spark.createDataFrame([(1, a), (1, b), (1, b + a), (2, a), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(df).collect())
    assert [g[1] == g[2] for g in got if g[0] == 2] == [True, True]
    assert sum(n - gone for d, n, gone in got) in (len(a) + len(b), len(a + b) + 99)  # 99: no string over the seam stands elsewhere


@pytest.mark.parametrize("slots", [1, 8])
def test_units_seen_before_are_told_by_the_task(monkeypatch, slots):
    import pyarrow as pa

    monkeypatch.setattr(suffixdedup, "SEEN", slots)
    rng = random.Random(2)
    same = "".join(rng.choice("abcdef ") for _ in range(150))
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([0], pa.int64()), pa.array([same])], names=["doc", "sub", "text"])
    rows = [r for b in suffixdedup._anchor_rows(batch(i) for i in (5, 6, 4, 7)) for r in b.to_pylist()]
    told = {(r["doc"], r["place"] < 0) for r in rows}
    assert (5, True) not in told and (4, True) not in told and (slots == 1 or {(6, True), (7, True)} <= told)


@pytest.mark.parametrize("ids", [[1, 2], [1, 1]])
def test_texts_are_shuffled_once(spark, ids):
    """By the plan: what the texts are dealt by is what both joins ask for, so nothing is dealt again on top of it."""
    text = "some words that go on for more than one hundred bytes, so that there is a string to find in it, and then some"
    df = spark.createDataFrame([(i, text + "." * n) for n, i in enumerate(ids)], "doc_id long, text string")
    out = suffixdedup.remove_repeats(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" :+-*") for line in plan.splitlines()]
    exchanges = [i for i, line in enumerate(lines) if line.startswith("Exchange") and "ENSURE_REQUIREMENTS" in line]
    assert exchanges and not [lines[i + 1] for i in exchanges if "REPARTITION_BY_COL" in lines[i + 1]]
    texts = {re.sub(r"#\d+L?|\[plan_id=\d+\]", "", " ".join(lines[i : i + 3])) for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line and "(doc" in line}
    assert len(texts) == 1
    assert sorted(r.n_removed for r in out.collect()) == [0, len(text)]
