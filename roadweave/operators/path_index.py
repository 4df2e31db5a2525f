"""A stored inverted index from links to paths: written once, read by each event only where its links lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, whole
from . import incidence as inc

#: Folders of the index, and tasks that write one: a link on very many paths is no task of its own.
BUCKETS, WRITERS = 256, 8


def _bucket(link: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(link), F.lit(buckets)).cast("int")


def write_path_index(paths: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes the index of paths (od_id, flow, path array<e_id>) to a folder that all executors share; an index that is there is replaced.

    ``paths``: path_id, path, n (trips on it), flow. ``links``: e_id, path_id, pos (the link's first place on the path), in a folder for
    each bucket of links, ordered by link within its files. ``meta``: the buckets, paths and links, written last, so an index without it is not whole.
    """
    spark = paths.sparkSession
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    meta.getFileSystem(spark._jsc.hadoopConfiguration()).delete(meta, True)
    inc.path_index(paths).write.mode("overwrite").parquet(f"{folder}/paths")
    index = spark.read.parquet(f"{folder}/paths")
    rows = index.select("path_id", F.posexplode(F.array_distinct("path")).alias("pos", "e_id")).withColumn("bucket", _bucket(F.col("e_id"), buckets))
    writer = F.pmod(F.xxhash64("path_id"), F.lit(WRITERS))
    rows.repartition("bucket", writer).sortWithinPartitions("bucket", "e_id").select("e_id", "path_id", "pos", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/links")
    sizes = index.agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.size(F.array_distinct("path"))), F.lit(0)).alias("links"))
    sizes.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def stored_candidates(spark: SparkSession, folder: str, damaged: DataFrame) -> DataFrame:
    """``incidence.index_candidates`` from a stored index: event, path_id, hits, path, n, flow of the paths that hold an event's damaged links (event, e_id).

    Only the buckets of the damaged links are read (their numbers, at most the index's buckets, go to the driver), and no
    path is taken apart. Repeated and null links hit once or never.
    """
    meta = spark.read.schema("paths long, links long, buckets int").json(f"{folder}/meta").first()
    asked = checkpointed(damaged.where("e_id IS NOT NULL").select("event", "e_id").distinct().withColumn("bucket", _bucket(F.col("e_id"), meta["buckets"])))
    wanted = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
    links = spark.read.schema("e_id string, path_id string, pos int, bucket int").parquet(f"{folder}/links").where(F.col("bucket").isin(wanted)) if meta["links"] else spark.createDataFrame([], "e_id string, path_id string, pos int, bucket int")
    met = links.join(whole(asked), ["bucket", "e_id"]).groupBy("event", "path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "e_id"))).alias("x"))
    met = met.select("event", "path_id", F.transform("x", lambda s: s["e_id"]).alias("hits"))
    return met.join(spark.read.parquet(f"{folder}/paths"), "path_id").select("event", "path_id", "hits", "path", "n", "flow")
