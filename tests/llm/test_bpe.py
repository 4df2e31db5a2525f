import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadweave.llm import bpe
from roadweave.llm.queries import op3_byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    with open(P.path(bpe.RANKS), "rb") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(codec, library, texts):
    for text, (ids, offsets) in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids, offsets) == text.encode()
        half = len(ids) // 2
        assert codec.decode(ids[half:], offsets[half:]) == b"".join(codec.tokens[i] for i in ids[half:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé字1٣½ \t\n 　\x00\x1c'strevlmd.,!😀́"), max_size=40), min_size=1, max_size=6))
def test_matches_the_library(codec, library, texts):
    same(codec, library, texts)


def test_long_and_odd_texts(codec, library):
    rng = random.Random(0)
    same(codec, library, ["", "\0", "'s's'll'", "x'SS 's", "a" * 3000, " " * 3000, " " * 50 + "a", "it's we'll  they'd\n\n don't", "".join(rng.choice("ab 'st\n") for _ in range(20_000)), "<|endoftext|>"])


def test_every_common_codepoint(codec, library):
    same(codec, library, ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x3400, 512)])


def test_query_matches_the_library(spark, library):
    rows = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {}
    for d, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        want[d] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in op3_byte_bpe(spark, SF).collect()}
    assert got == want


def test_nulls_repeats_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "a b", 5), (2, "a b", 5)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in out) == [(0, 0, b""), (1, 0, b""), (2, 2, b"a b"), (2, 2, b"a b")]
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.round_trip(df).collect()) == sorted((r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out)
    assert bpe.encode(df.where(F.lit(False))).count() == 0


def test_text_beyond_a_slice(spark, library):
    rng = random.Random(4)
    text = " ".join(rng.choice(["word", "x1", "'ll", "é!", "\n"]) for _ in range(200_000))
    assert len(text) > 2 * bpe.CHUNK_BYTES
    df = spark.createDataFrame([(1, "a"), (2, text), (3, "b")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert np.frombuffer(got[2].ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(got[2].decoded) == text.encode() and bytes(got[3].decoded) == b"b"
