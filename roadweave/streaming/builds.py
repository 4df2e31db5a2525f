"""Builds that go on where they stopped: files of commuters are turned into county tables once each, by a stream that ends when none is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand

#: The end of a file's path: state, part (main or aux), kind of job and year; or a folder of that name with Spark's files.
FILE = r"([^/]+?)_od_(main|aux)_([A-Za-z0-9]+)_([0-9]{4})\.csv[^/]*(?:/part-[^/]*)?$"


def build_counties(spark: SparkSession, files: str, lookup: DataFrame, out: str, state: str, files_a_batch: int = 256, done: Callable[[int], None] | None = None) -> DataFrame:
    """origin, destination, year, job_type, jobs of all files of commuters (a folder or glob) that were ever seen.

    ``out`` takes a folder a file and ``state`` what the stream remembers, both on shared storage. A run takes the files
    that no earlier one finished, so many at a time, and ends. A batch that was cut off is done again whole, and replaces
    its files' folders, so rows never count twice. A file is whole in one batch; its first columns are w_geocode, h_geocode and S000, below
    a line of these names. Paths other than FILE's, and files with these columns in another order, raise an error.
    A block that the lookup lists twice raises ValueError. ``done`` hears of each batch after its rows are written.
    """
    names = lambda i: F.regexp_extract("__path", FILE, i)
    pairs = lookup.select("block", "county")

    def upsert(batch: DataFrame, number: int) -> None:
        unknown = F.raise_error(F.concat(F.lit("no file of commuters: "), "__path")).cast("string")
        head = F.col("w_geocode") == "w_geocode"
        bad = (names(1) == "") | (head & (F.col("h_geocode") != "h_geocode")) | (F.col("w_geocode") == "h_geocode")
        rows = batch.where(~F.coalesce(head, F.lit(False)) | bad).select(
            F.trim("h_geocode").alias("home"), F.trim("w_geocode").alias("work"), F.col("S000").try_cast("long").alias("jobs"),
            F.when(bad, unknown).otherwise(F.translate(names(0), "/", "+")).alias("file"), names(4).try_cast("int").alias("year"), names(3).alias("job_type"),
        )
        counties = demand.commuter_od(rows, pairs, ["file", "year", "job_type"])
        counties.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)
        if done:
            done(number)

    stream = spark.readStream.schema("w_geocode string, h_geocode string, S000 string").option("maxFilesPerTrigger", files_a_batch).csv(files)
    query = stream.select("*", F.col("_metadata.file_path").alias("__path")).writeStream.foreachBatch(upsert).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    parts = spark.read.schema("origin string, destination string, year int, job_type string, jobs long, file string").parquet(out)
    return parts.groupBy("origin", "destination", "year", "job_type").agg(F.sum("jobs").alias("jobs"))
