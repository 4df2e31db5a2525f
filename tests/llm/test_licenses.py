import random

import duckdb
from pyspark.sql import functions as F

from roadweave.llm import licenses
from roadweave.llm.queries import op1_license_scan

SF = "/root/testdata/sf0.01"


def oracle(docs):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    return {tuple(r) for r in con.execute(licenses.sql()).fetchall()}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {tuple(r) for r in con.execute(licenses.sql()).fetchall()}
    got = op1_license_scan(spark, SF)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_edited_long_templates_at_any_offset(spark):
    rng = random.Random(0)
    docs = []
    for i, text in enumerate(list(licenses.TEMPLATES.values()) * 4):
        w = text.split()
        for _ in range(len(w) // 60):
            w[rng.randrange(len(w))] = "edited"
        docs.append((i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 90))) + "\n" + " ".join(w).upper() + " tail" * rng.randrange(0, 50)))
    docs.append((1000, " ".join(licenses.TEMPLATES["mit"].split()[:40])))
    got = {tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == oracle(docs) and len({r[0] for r in got}) > 40


def test_nulls_repeats_long_and_empty(spark):
    docs = [(1, None), (2, ""), (3, "x All rights reserved"), (3, "x All rights reserved"), (4, "word " * 900 + "released under the MIT license"), (5, "rights reserved")]
    df = spark.createDataFrame([(*d, "z") for d in [*docs, (None, "all rights reserved")]], "doc_id long, text string, license string")
    got = {tuple(r) for r in licenses.scan(df).collect()}
    assert got == oracle(docs) and {r[:2] for r in got} == {(3, "all-rights-reserved"), (4, "mit-notice")}
    assert licenses.scan(df.where(F.lit(False))).count() == 0
    long = spark.createDataFrame([(1, "word " * 60_000 + "released under the MIT license")], "doc_id long, text string")
    assert [r.license for r in licenses.scan(long).collect()] == ["mit-notice"]
    assert licenses.scan(df, {}).count() == 0 and licenses.scan(df, {"none": "..."}).count() == 0


def test_many_templates_take_several_passes(spark, monkeypatch):
    docs = [(i, f"x {t} y") for i, t in enumerate(licenses.TEMPLATES.values())]
    monkeypatch.setattr(licenses, "PASS_SHINGLES", 40)
    assert {tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == oracle(docs)


def test_rows_of_one_id_are_one_document(spark):
    """As in the SQL: halves of a license in two rows are the license; ids may be texts."""
    w = licenses.TEMPLATES["mit"].split()
    docs = [(1, " ".join(w[:55])), (1, " ".join(w[45:])), (2, " ".join(w[:55])), (3, "All rights reserved"), (3, None), (3, "all rights reserved, " * 3)]
    got = {tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == oracle(docs) and {r[:2] for r in got} == {(1, "mit"), (3, "all-rights-reserved")}
    named = licenses.scan(spark.createDataFrame([(f"d{i}", t) for i, t in docs], "doc_id string, text string"))
    assert {(int(r.doc_id[1:]), *r[1:]) for r in named.collect()} == got
    empty = licenses.scan(spark.createDataFrame([], "doc_id string, text string"), {})
    assert empty.schema["doc_id"].dataType.typeName() == "string" and empty.count() == 0
