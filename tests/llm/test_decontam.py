import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import decontam
from roadweave.llm.queries import op5_decontamination

SF = "/root/testdata/sf0.001"


def words(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    w = words(text)
    hit, ids = set(), set()
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 9) if x else 0):
            win = x[k : k + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(i)
    return len(w), len(hit), len(ids), decontam.digest_of(ids), bool(hit)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(decontam.SQL).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in op5_decontamination(spark, SF).collect()}
    assert got == want and any(r[-1] for r in got.values())


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (12, "short item"), (2, "é-Ü x"), (3, "..."), (4, None), (5, "short")]
TEXTS = ["zero ONE two three, four five six seven\neight nine ten eleven twelve", "a SHORT! item b", "shortitem short", "É Ü x", "é ü x é-Ü.x", "", None, "one two " * 30_000, "two three four five six seven eight nine ten eleven", "1short item2"]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "z")], "doc_id long, text string, spans string")
    items = spark.createDataFrame([*ITEMS, (None, "two")], "item_id long, text string")
    got = [tuple(r) for r in decontam.digest(decontam.contamination(docs, items)).collect()]
    assert sorted(got) == sorted((i, *brute(t, [x for x in ITEMS if x[1]])) for i, t in [*enumerate(TEXTS), (1, TEXTS[1])])


def test_text_ids_and_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "y"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([("b", "y"), ("a", "x y"), ("a", "z"), ("c", "w")], "item_id string, text string")
    assert [r.item_ids for r in decontam.contamination(docs, items).sort("doc_id").collect()] == [["a", "b"], ["b"], []]


@pytest.mark.parametrize("seed", range(6))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice("abcd"[: 2 + seed % 3]) for _ in range(rng.randrange(most)))
    items = [(i, text(30)) for i in range(8)]
    texts = [text(400) for _ in range(30)]
    ac = decontam.Automaton.unpack(np.frombuffer(decontam.Automaton.of([t.encode() for _, t in items], 10).pack(), np.uint8))
    number = ac.numbers() | {decontam.BETWEEN: -2}
    for t, (n, runs, owners) in zip(texts, decontam.scan([t.encode() for t in texts], ac, number), strict=True):
        assert (n, sum(b - a for a, b in runs), len(owners), decontam.digest_of(set(owners)), bool(runs)) == brute(t, items)


def test_spans_are_bytes_of_the_text(spark):
    text = "ééé ... One, TWO three four five six seven eight nine ten! rest"
    row = decontam.contamination(spark.createDataFrame([(0, text)], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert [text.encode()[s.start : s.stop].decode() for s in row.spans] == ["One, TWO three four five six seven eight nine ten"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(docs.where(F.lit(False)), items).count() == 0
    row = decontam.contamination(docs, items.where(F.lit(False))).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
