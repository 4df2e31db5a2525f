"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import HOT_ROWS, HOT_SHARE, checkpointed, join_by_hot_key


#: Edges of about which a task is at least: later rounds have few.
TASK_EDGES = 50_000


def _state(e: DataFrame) -> tuple[bool, bool, int]:
    """Whether every edge leads from a node with no other edge to one from which no edge leads; whether a node is hot; and in how many tasks to read the edges."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"), F.count("*").alias("edges"))
    wrong, most, total = nodes.agg(F.count_if(F.expr("out > 1 OR (out > 0 AND into > 0)")), F.max("edges"), F.sum("edges")).first()
    tasks = max(e.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // (2 * TASK_EDGES)))
    return not wrong, (most or 0) > max(HOT_ROWS, (total or 0) // HOT_SHARE), tasks


def _with_least(e: DataFrame, least: DataFrame, hot: bool) -> DataFrame:
    """The edges with their first node's least neighbour; where a node is hot, its edges are scattered."""
    return join_by_hot_key(e, checkpointed(least), "u", "n") if hot else e.join(least.drop("n"), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that ``edges`` (u, v of one orderable type) names; component is the smallest node reachable.

    Alternates large-star and small-star steps: both keep the components and move every edge towards its smallest node,
    and their numbers of edges never exceed the input's. A star's minimum is a partial aggregate, so a node with very
    many neighbours costs no task more than its share; the join back scatters such nodes' edges. Each round is a
    checkpoint in the shared folder, so a lost executor costs one round at most. The rounds, a few times the logarithm of
    the longest path, end when the edges are stars, which is looked up exactly. Self-loops, repeated edges and nulls are
    dropped; no edges give no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e = checkpointed(e.distinct())
    e = e.where("u <> v")
    while not (state := _state(e))[0]:
        e = e.coalesce(state[2])
        # Large-star: every neighbour above a node is linked to the smallest node of that node's neighbourhood.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least, state[1]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: a node and its smaller neighbours are linked to the smallest of these.
        large = checkpointed(large).coalesce(state[2]) if state[1] else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, state[1]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = checkpointed(small)
    roots = nodes.select(F.col("u").alias("node")).union(nodes.select("v")).distinct()
    return roots.join(e.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
