"""Writers: one folder a table, partitions by key, reports, summaries and where they lie."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, in folders by key if asked; rows of a key are gathered first, so each folder has few files."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header, as many files as the table has partitions."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_by_suffix(df: DataFrame, path: str) -> None:
    """Parquet for .parquet and .pq, CSV for anything else."""
    if path.lower().endswith((".parquet", ".pq")):
        write_table(df, path)
    else:
        write_report(df, path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a table, which is made if it is not there."""
    write_table(df, path, mode="append")


def combine(spark: SparkSession, parts: list[str], path: str) -> DataFrame:
    """Tables of parts as one table, columns by name."""
    rows = [spark.read.parquet(p) for p in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    write_table(out, path)
    return spark.read.parquet(path)


def summary_json(df: DataFrame, path: str) -> dict:
    """The one row of a summary as JSON; more rows raise ValueError."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    out = rows[0].asDict(recursive=True)
    Path(path).write_text(json.dumps(out, indent=2, default=str, sort_keys=True))
    return out


def result_path(root: str, stage: str, variant: str, key: int | str, event: str | None = None) -> str:
    """Where a stage's table of a scenario lies: root/stage/variant/key[/event]."""
    return "/".join([root.rstrip("/"), stage, variant, str(key), *([event] if event else [])])
