import base64
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from test_decontam import brute as brute_hits
from test_simhash import brute_components, brute_fp

import corpus_pipeline
from roadweave.llm import bpe, secrets

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    con = duckdb.connect()
    rows = con.execute(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    items = con.execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    rows = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    rows = [rows[i] for i, c in enumerate(brute_components([brute_fp(t) for _, t in rows])) if c == i]
    rows = [(d, t) for d, t in rows if not brute_hits(t, items)[-1]]
    rows = [(d, re.sub(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{16,}|(?<=token = \")[0-9a-f]{40}", secrets.MASK, t)) for d, t in rows]
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in rows:
        ids = np.array(library.encode_ordinary(t), "<u4")
        want[d] = (len(ids), ids.tobytes(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_columns_and_bear_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "the word is good and the day is long", "en"), (3, "the word is good and the day is long", "en"), (4, "los dias son largos y buenos", "es"), (None, "the word is good", None), (5, "!!! 123", "en")]
    docs = spark.createDataFrame([(*r, "src", 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        assert stage(spark, docs.where(F.lit(False)), SF).count() == 0
        out = stage(spark, docs, SF)
        assert last or sorted(out.columns) == sorted(docs.columns)
        ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
        assert ids == {"language_id": ["3", "3", "4", "None"], "simhash_dedup": ["1", "3", "4", "5"]}.get(name, ["1", "2", "3", "3", "4", "5", "None"]), name


def test_stages_bear_long_texts_ties_and_clashing_names(spark):
    long = "the word is good and the day is long " * 20_000
    rows = [(1, long, "en"), (2, "el dia es largo y la palabra es buena para todos", "es"), (2, "a different text of the same id, in plain words", "en"), (7, "el dia es largo y la palabra es buena para todos", "es"), (None, None, None)]
    names = "score string, __key string, __n string, n_hit string, spans string, c0 string, ids string, decoded string"
    docs = spark.createDataFrame([(*r, "s", 1, *"abcdefgh") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == [x.split()[0] for x in names.split(", ")], name
        assert {tuple(r)[5:] for r in docs.collect()} == {tuple("abcdefgh")}, name
    assert sorted((r.doc_id, len(r.text)) for r in docs.collect()) == [(1, len(long)), (2, 47), (2, 48)]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in last.collect()) == [1, 2, 2]
