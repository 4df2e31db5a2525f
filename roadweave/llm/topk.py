"""Exact top-k inner products by a dual cover-tree search, over blocks that are the trees' top-level cells."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, checkpointed

#: Rows of one block of queries and of candidates: one task holds one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Cells at most, and about how many candidates (by their ids' hash) the cells' centres are picked from.
CELLS, SAMPLE = 1024, 8192
#: Points of a leaf and children of a node. A node's centres are its farthest-first net: they are apart by no less than
#: what the net leaves uncovered, and the first is the node's own centre.
LEAF, FANOUT = 8, 12
#: Pairs of nodes with so few products are worked out at once, as one product of matrices.
AT_ONCE = 4096


@dataclass
class Node:
    """``radius`` and ``angle`` cover the rows from the centre; ``norm`` is the longest row's."""

    rows: np.ndarray
    centre: int
    radius: float
    angle: float
    norm: float
    children: list[Node] = field(default_factory=list)


def _angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to the centre; a row or centre of length 0 is as far as can be."""
    size = np.sqrt((x**2).sum(axis=1)) * np.sqrt((centre**2).sum())
    return np.where(size > 0, np.arccos(np.clip(x @ centre / np.where(size > 0, size, 1), -1, 1)), np.pi)


def net(x: np.ndarray, most: int, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A farthest-first net of rows: the centres, each row's centre and its distance."""
    near = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
    centres, owner = [first], np.zeros(len(x), int)
    while len(centres) < most and near[far := int(near.argmax())] > 0:
        d = np.sqrt(((x - x[far]) ** 2).sum(axis=1))
        owner[d < near] = len(centres)
        near = np.minimum(near, d)
        centres.append(far)
    return centres, owner, near


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree over rows of ``x``: nested centres, measured covering radii, separated siblings."""
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    mine = x[rows]
    near = np.sqrt(((mine - x[centre]) ** 2).sum(axis=1))
    node = Node(rows, centre, float(near.max()), float(_angles(mine, x[centre]).max()), float(np.sqrt((mine**2).sum(axis=1)).max()))
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centres, owner, _ = net(mine, FANOUT, int(np.flatnonzero(rows == centre)[0]))
    node.children = [cover_tree(x, rows[owner == i], int(rows[c])) for i, c in enumerate(centres)]
    return node


def upper_bound(product: float, a_norm: float, b_norm: float, a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    """The largest product of a row of each of two groups, of (radius, angle, longest row), whose centres' product and lengths are given.

    The smaller of two bounds: the centres' product and what both radii can add; and the longest rows at the smallest
    angle that both groups' angles leave. Rounding is allowed for.
    """
    by_radius = product + a_norm * b[0] + b_norm * a[0] + a[0] * b[0]
    between = np.arccos(np.clip(product / (a_norm * b_norm), -1, 1)) if a_norm * b_norm > 0 else 0.0
    by_angle = a[2] * b[2] * max(0.0, float(np.cos(max(0.0, between - a[1] - b[1]))))
    return min(by_radius, by_angle) + 1e-9 * (abs(by_radius) + a[2] * b[2] + a_norm * b_norm + 1)


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """(query's place, point id, score) of each query's k best points, ties to the smaller id; and the products worked out.

    A query is itself one of the points with its id and vector, where there is one: that one is left out, and no other.
    ``floor`` is a score that each query has k points of elsewhere: lower ones are not looked for. Scores must fit a long.
    Equal points are one point of the tree with a list of ids; of these a query can need its k + 1 smallest at most, and
    its own.
    Pairs of nodes are visited by their bound. A pair is pruned if that is below the worst k-th score of the group's
    queries; equal bounds are visited, as ties count.
    """
    points, which = np.unique(points, axis=0, return_inverse=True)
    order = np.lexsort((point_ids, which.ravel()))
    cuts = np.searchsorted(which.ravel()[order], np.arange(len(points) + 1))
    ids = [point_ids[order[a:b]] for a, b in itertools.pairwise(cuts.tolist())]
    place = {tuple(v): i for i, v in enumerate(points.tolist())}
    own = [place.get(tuple(v), -1) for v in queries.tolist()]
    # Products of doubles are exact below 2**53; larger ones are worked out in Python's integers.
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * max(1, points.shape[1]) < 2.0**52
    q, p = queries.astype(float), points.astype(float)
    q_norm, p_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((p**2).sum(axis=1))
    best: list[list[tuple[int, int]]] = [[] for _ in q]  # heaps of (score, -id)
    low = np.full(len(q), -np.inf) if floor is None else floor.astype(float)
    worst = low.copy()
    products = 0

    def bound(a: Node, b: Node) -> float:
        return upper_bound(float(q[a.centre] @ p[b.centre]), float(q_norm[a.centre]), float(p_norm[b.centre]), (a.radius, a.angle, a.norm), (b.radius, b.angle, b.norm))

    def base(a: Node, b: Node) -> None:
        nonlocal products
        products += len(a.rows) * len(b.rows)
        scores = q[a.rows] @ p[b.rows].T if exact else queries[a.rows].astype(object) @ points[b.rows].T.astype(object)
        hit = scores >= worst[a.rows][:, None]
        width = min(k + 1, len(b.rows))  # one more than k, as the query's own row may be among them
        if exact and width < len(b.rows):
            hit &= scores >= np.partition(scores, len(b.rows) - width, axis=1)[:, len(b.rows) - width, None]
        for i, j in np.argwhere(hit.astype(bool)).tolist():
            row, point, score, heap = int(a.rows[i]), int(b.rows[j]), int(scores[i, j]), best[a.rows[i]]
            itself = point == own[row]
            for other in ids[point][: k + 1].tolist():
                if itself and other == query_ids[row]:
                    itself = False
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (score, -other))
                elif (score, -other) > heap[0]:
                    heapq.heapreplace(heap, (score, -other))
                else:
                    break
            if len(heap) == k:
                worst[row] = max(low[row], heap[0][0])

    if len(q) and len(p):
        tick = itertools.count()
        roots = cover_tree(q), cover_tree(p)
        queue = [(-bound(*roots), next(tick), *roots)]
        while queue:
            top, _, a, b = heapq.heappop(queue)
            if -top < worst[a.rows].min():
                continue
            if len(a.rows) * len(b.rows) <= AT_ONCE or not a.children and not b.children:
                base(a, b)
                continue
            split_a = a.children and (not b.children or a.radius >= b.radius)
            for x, y in [(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]:
                if (up := bound(x, y)) >= worst[x.rows].min():
                    heapq.heappush(queue, (-up, next(tick), x, y))
    found = [(i, -m, s) for i, heap in enumerate(best) for s, m in heap]
    return (tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(3))), products


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id long, dim int, x array<long> = floor(scale * component), components as doubles; rows with a null id, a null or empty vector, or a null or non-finite component are left out."""
    d = F.transform(vector_col, lambda v: v.cast("double"))
    bad = F.exists(d, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), F.transform(d, lambda v: F.floor(v * scale)).alias("x"))


def _with_times(df: DataFrame) -> DataFrame:
    """Equal rows as one, with their number; a partial aggregate, so an id with very many rows is no hot task."""
    return df.groupBy("id", "dim", "x").agg(F.count("*").alias("times"))


def _centres(candidates: DataFrame, sizes: dict[int, int], block: int) -> dict[int, np.ndarray]:
    """Each length's centres: a farthest-first net of a sample, one for about every block of candidates."""
    if not sizes:
        return {}
    # A share by the ids' hash needs no order of all candidates.
    share = F.create_map(*[F.lit(v) for d, n in sizes.items() for v in (d, int(min(1.0, SAMPLE / n) * 2**40))])
    rows = candidates.where(F.pmod(F.xxhash64("id"), F.lit(2**40)) < share[F.col("dim")]).select("id", "dim", "x").collect()
    by_dim: dict[int, list[list[int]]] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        by_dim.setdefault(r["dim"], []).append(r["x"])
    return {d: (x := np.array(v, float))[net(x, min(CELLS, -(-sizes[d] // block)))[0]] for d, v in by_dim.items()}


def _in_cells(df: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The rows (id, dim, x, times) with cell (the nearest centre, ties to the first), and the distance and angle to it."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors a length at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(1).to_numpy()
            ends, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            cell, far, angle = np.zeros(len(dim), np.int32), np.zeros(len(dim)), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                if d not in shared.value:
                    continue
                at = np.flatnonzero(dim == d)
                x, c = flat[ends[at][:, None] + np.arange(d)].astype(float), shared.value[d]
                cell[at] = ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)
                for i in np.unique(cell[at]).tolist():
                    mine = cell[at] == i
                    far[at[mine]] = np.sqrt(((x[mine] - c[i]) ** 2).sum(axis=1))
                    angle[at[mine]] = _angles(x[mine], c[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(angle)], names=["id", "dim", "x", "times", "cell", "far", "angle"])

    return df.select("id", "dim", "x", "times").mapInArrow(run, "id long, dim int, x array<long>, times long, cell int, far double, angle double")


def _blocks(rows: DataFrame, block: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their part of their cell, and a row a block: dim, cell, part, radius, angle, longest row."""
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # CELLS rows a length at most
    rows = rows.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v))
    stats = rows.groupBy("dim", "cell", "part").agg(F.max("far"), F.max("angle"), F.max(norm)).toDF("dim", f"{name}_cell", f"{name}_part", f"{name}_radius", f"{name}_angle", f"{name}_norm")
    return rows.drop("parts", "far", "angle").withColumnsRenamed({"cell": f"{name}_cell", "part": f"{name}_part"}), stats


def _bounds(pairs: DataFrame, centres: dict[int, np.ndarray]) -> Column:
    @F.pandas_udf("double")
    def bound(dim: pd.Series, a: pd.Series, b: pd.Series, ar: pd.Series, aa: pd.Series, an: pd.Series, br: pd.Series, ba: pd.Series, bn: pd.Series) -> pd.Series:
        out = []
        for d, i, j, *rest in zip(dim, a, b, ar, aa, an, br, ba, bn, strict=True):
            x, y = centres[d][i], centres[d][j]
            out.append(upper_bound(float(x @ y), float(np.sqrt(x @ x)), float(np.sqrt(y @ y)), tuple(rest[:3]), tuple(rest[3:])))
        return pd.Series(out, dtype=float)

    return bound("dim", "q_cell", "c_cell", "q_radius", "q_angle", "q_norm", "c_radius", "c_angle", "c_norm")


def _searched(q: DataFrame, c: DataFrame, key: list[str], k: int) -> DataFrame:
    """row, query_id, times, vec_id, score: the k best of each key's candidates for each of its queries (with ``low``, a floor)."""

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"row": [], "query_id": [], "times": [], "vec_id": [], "score": []}).astype("int64")
        low = np.array([-np.inf if v is None or v != v else v for v in a["low"]])
        # Of equal candidates k and the query's own can be needed.
        copies = np.repeat(np.arange(len(b)), np.minimum(b["times"], k + 1))
        found, _ = block_top_k(np.stack(a["x"]), a["id"].to_numpy(), np.stack(b["x"])[copies], b["id"].to_numpy()[copies], k, low)
        mine = a[["row", "id", "times"]].iloc[found[0]].reset_index(drop=True).rename(columns={"id": "query_id"})
        return mine.assign(vec_id=found[1], score=found[2])

    q, c = q.toDF(*q.columns), c.toDF(*c.columns)  # both may come from one table, whose columns would be ambiguous
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(search, "row long, query_id long, times long, vec_id long, score long")


def surviving_pairs(q_stats: DataFrame, c_stats: DataFrame, low: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Of the pairs of a block of queries and one of candidates those whose bound reaches the worst k-th score of the queries so far.

    Cells are paired first, CELLS times CELLS a length at most, with what covers all their blocks; then the blocks of the pairs that are left.
    """
    reached = lambda pairs: pairs.withColumn("bound", _bounds(pairs, centres)).where(F.col("low").isNull() | (F.col("bound") >= F.col("low")))
    q_stats = q_stats.join(low, ["dim", "q_cell", "q_part"], "left")
    worst = lambda name: [F.max(f"{name}_{c}").alias(f"{name}_{c}") for c in ("radius", "angle", "norm")]
    least = F.when(F.count("*") == F.count("low"), F.min("low")).alias("low")
    cells = reached(q_stats.groupBy("dim", "q_cell").agg(least, *worst("q")).join(c_stats.groupBy("dim", "c_cell").agg(*worst("c")), "dim"))
    blocks = cells.select("dim", "q_cell", "c_cell").join(q_stats, ["dim", "q_cell"]).join(c_stats, ["dim", "c_cell"])
    return reached(blocks).select("dim", "q_cell", "q_part", "c_cell", "c_part")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer products over all candidates but itself.

    Both sides have id, dim and x, as ``integers`` gives them; vectors of different lengths never meet. Every row is a query
    or candidate of its own, rows of one id and equal rows too: a query is left out of its own candidates as one row of
    its id and vector, where they have one, and each query row gets its ranks. Ties go to the smaller id; fewer candidates
    give fewer rows. Ids are whole numbers.

    Queries and candidates are dealt to the same cells, the top level of both trees; a cell of more than a block is
    parted. A query first searches a block of its own cell, which gives it a k-th score; then the other pairs of blocks whose
    bound is below the worst k-th score of the block's queries are dropped before anything is sent, and the rest are searched by
    a dual tree, a task a pair, which holds those two blocks only. The last step ranks k rows a query and block.
    """
    bounded_batches(queries.sparkSession)
    q, c = _with_times(queries), _with_times(candidates)
    sizes = {r["dim"]: r["count"] for r in c.groupBy("dim").count().collect()}
    centres = _centres(c, sizes, candidate_block)
    q, q_stats = _blocks(checkpointed(_in_cells(q, centres).withColumn("row", F.monotonically_increasing_id())), query_block, "q")
    c, c_stats = _blocks(checkpointed(_in_cells(c, centres)), candidate_block, "c")
    parts = c_stats.groupBy("dim", F.col("c_cell").alias("q_cell")).agg(F.max("c_part").alias("last"))
    near = q.join(F.broadcast(parts), ["dim", "q_cell"]).withColumn("c_part", F.pmod("q_part", F.col("last") + 1)).withColumn("c_cell", F.col("q_cell")).withColumn("low", F.lit(None).cast("double"))
    # Each block of candidates meets the blocks of its own cell's queries that chose it.
    key = ["dim", "q_cell", "q_part", "c_cell", "c_part"]
    met = checkpointed(near.select(*key).distinct())
    first = checkpointed(_searched(near, c.join(met, ["dim", "c_cell", "c_part"]), key, k))
    kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("low"))
    q = checkpointed(q.join(kth, "row", "left"))
    low = q.groupBy("dim", "q_cell", "q_part").agg(F.when(F.count("*") == F.count("low"), F.min("low")).alias("low"))
    pairs = checkpointed(surviving_pairs(q_stats, c_stats, low, centres).join(met, key, "left_anti"))
    found = first if pairs.isEmpty() else first.union(_searched(q.join(pairs, key[:3]), c.join(pairs, ["dim", "c_cell", "c_part"]), key, k))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
),
s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.i <> c.i AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
