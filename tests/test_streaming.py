from pyspark.sql import functions as F

from roadweave.streaming.exposure import windowed_exposure

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("e"), "user_id").alias("e_id"), F.col("value").alias("intensity"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_exposure(rows(stream)).writeStream.format("memory").queryName("exposed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT * FROM exposed").collect()}
    finally:
        query.stop()
    assert got and got == {tuple(r) for r in windowed_exposure(rows(events)).collect()}
