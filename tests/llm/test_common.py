from pyspark.sql import functions as F

from roadweave.llm import _common


def test_join_by_hot_key(spark, monkeypatch):
    monkeypatch.setattr(_common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([7] * 40 + [8] * 3 + [9, 10, None])], "key long, i int")
    table = rows.where("key < 10").groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    got = sorted(tuple(r) for r in _common.join_by_hot_key(rows, table, "key", "n").collect())
    assert got == [(k, i, {7: 39, 8: 42, 9: 43}[k]) for i, k in enumerate([7] * 40 + [8] * 3 + [9])]
    assert _common.join_by_hot_key(rows, table.where("key < 9"), "key", "n").columns == ["key", "i", "most"]
    assert _common.join_by_hot_key(rows.where("key = 1"), table, "key", "n").count() == 0


def test_hot_keys_are_parted_alike_and_their_values_shuffled(spark):
    from pyspark.sql import functions as F

    from roadweave.llm._common import join_by_hot_key

    rows = spark.range(4000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"), "id", F.lit(None).cast("string").alias("none"))
    table = rows.groupBy("key").count().where("key <> 'k3'").withColumn("value", F.repeat("key", 10_000))
    got = join_by_hot_key(rows, table, "key", "count")
    assert got.columns == ["key", "id", "none", "value"]
    want = {(r.key, r.id) for r in rows.where("key <> 'k3'").collect()}
    assert {(r.key, r.id) for r in got.select("key", "id").collect()} == want and got.count() == len(want)
    assert got.where("value <> repeat(key, 10000)").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rand" not in plan
    # Only the hot keys and their parts are under the broadcast hint, and a part has as many rows as its share.
    parts = join_by_hot_key(rows, table, "key", "count").where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 1500


def test_text_ids(spark):
    from roadweave.llm import paradedup, quality

    line = "one two three four five six seven eight"
    docs = spark.createDataFrame([("b", f"{line}\nx"), ("a", line), ("c", "y")], "doc_id string, text string")
    got = sorted(tuple(r) for r in paradedup.duplicate_paragraphs(docs).collect())
    assert got == [("a", 0, 8, "a", 0, 2, False), ("b", 0, 8, "a", 0, 2, True)]
    rows = [(f"d{i}", "good prose of some words. " * 5 if i % 2 else "<<<>>> $$$ ###\n" * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)], "doc_id string, quality int")
    model = quality.train(df, labels)
    scores = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert min(scores["d1"], scores["d3"]) > max(scores["d0"], scores["d2"])
