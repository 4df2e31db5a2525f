import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from roadweave.llm import passages
from roadweave.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(docs, length=50):
    """Sorted (doc, first word, words, removed, first doc): every window compared with every other."""
    docs = list(dict.fromkeys((d, t) for d, t in docs if d is not None and t is not None))
    cut = [(d, words(t)) for d, t in docs]
    holders = {}
    for d, w in cut:
        for s in range(len(w) - length + 1):
            holders.setdefault(tuple(w[s : s + length]), set()).add(d)
    out = []
    for d, w in cut:
        hit, gone, least = [False] * len(w), [False] * len(w), {}
        for s in range(len(w) - length + 1):
            held = holders[tuple(w[s : s + length])]
            if len(held) > 1:
                least[s] = min(held)
                for i in range(s, s + length):
                    hit[i] = True
                    gone[i] |= min(held) < d
        s = 0
        while s < len(w):
            e = s
            while e < len(w) and hit[e]:
                e += 1
            if e > s:
                out.append((d, s, e - s, sum(gone[s:e]), min(v for k, v in least.items() if s <= k < e)))
            s = max(e, s + 1)
    return sorted(out)


def result(df, **more):
    return sorted((r.doc_id, r.first_word, r.n_words, r.n_removed, r.first_doc_id) for r in passages.repeated_passages(df, **more).collect())


def test_query_matches_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries()["repeated_passages"](spark, SF)
    rows = sorted(tuple(r) for r in got.collect())
    cur = con.execute(oracle_sql()["repeated_passages"])
    assert [c[0] for c in cur.description] == got.columns
    assert rows and rows == sorted(cur.fetchall()) == brute(con.execute("select doc_id, text from documents").fetchall())


def test_planted_within_and_across_lines_and_short_lines_that_recur(spark):
    """Lines as the unit find none of the planted passages, but every document with a common short line."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for i in range(20):
        p = new(51 + i)
        docs.append((2 * i, " ".join([*new(70), *p, *new(80)])))
        docs.append((2 * i + 1, " ".join([*new(33), *[x.upper() + rng.choice([" ", "\n", "-"]) for x in p], *new(50)])))
    docs += [(i, f"{' '.join(new(60))}\nRead more\n{' '.join(new(60))}") for i in range(100, 120)]
    got = result(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute(docs) == sorted(r for i in range(20) for r in [(2 * i, 70, 51 + i, 0, 2 * i), (2 * i + 1, 33, 51 + i, 51 + i, 2 * i)])


@pytest.mark.parametrize(("length", "letters"), [(5, "ab"), (7, "abc"), (1, "abcdefghijklmnop")])
def test_few_words_so_that_all_overlap(spark, length, letters):
    rng = random.Random(length)
    docs = [(i // 2, " ".join(rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(90, "a " * 300), (91, "a " * 40 + "b " * 40), (92, "")]
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=length) == brute(docs, length)


def test_nulls_repeats_other_ids_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = [("b", t), ("b", t), ("a", None), (None, t), ("c", f"x {t}"), ("c", f"y z {t}"), ("d", "w1 w2"), ("e", f"{t[:100]} {t[:100]}" * 9)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id string, text string, sub int")
    assert result(df) == brute(docs) == [("b", 0, 60, 0, "b"), ("c", 1, 60, 60, "b"), ("c", 2, 60, 60, "b")]
    assert result(df.where("doc_id = 'c'")) == []
    assert result(df.where(F.lit(False))) == []


def test_one_passage_everywhere(spark):
    rng = random.Random(5)
    p = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(600):
        q = p.copy()
        q[rng.randrange(80)] = f"v{i}"
        docs.append((i, " ".join([str(rng.randrange(10**9)), *q, str(rng.randrange(10**9))])))
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)) == brute(docs)
