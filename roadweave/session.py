"""A Spark session with the settings that the plans assume."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table, of links say, up to which it goes whole to every executor (some 100 bytes each).
WHOLE_ROWS = 1_000_000


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; anything else by ``conf``."""
    builder = SparkSession.builder.appName("roadweave")
    builder = builder.master(master) if master else builder
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and the executors share.

    Where none is set, a session within one process gets a folder of its own; on a cluster that is an error, as a folder
    of the driver's machine is not there for the executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="roadweave-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Cuts the lineage by a compressed table in the shared folder: for what is large. It stays there as checkpoints do, or until ``discard``."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def whole(df: DataFrame) -> DataFrame:
    """A table of few columns, read or checkpointed, that joins send whole to every executor if it is short enough: the other side's rows stay where they are."""
    return F.broadcast(df) if df.count() <= WHOLE_ROWS else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has written and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
