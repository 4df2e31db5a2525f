"""Least-cost paths over networks of any size: on every worker's copy where it fits, else cell by cell."""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, discard, stored
from .network import Network, least_cost_paths

#: Links up to which a network goes whole to every worker (some 60 bytes each and its names), nodes of a cell, nodes of the cells of a task, its origins.
WHOLE_LINKS, CELL_NODES, BLOCK_NODES, ORIGINS = 2_000_000, 20_000, 200_000, 64
#: Nodes of about which a task that numbers cells is, at least.
RANGE_NODES = 200_000


def find_paths(od: DataFrame, edges: DataFrame, directed: bool = False, needs: bool = False, whole_links: int = WHOLE_LINKS) -> DataFrame:
    """``least_cost_paths`` where the links are few enough for every worker to hold, else ``cell_paths``, whose paths have no ``needs`` (null)."""
    if edges.count() <= whole_links:
        return least_cost_paths(od, edges, directed, needs)
    out = cell_paths(od, edges, directed=directed)
    return out.withColumn("needs", F.lit(None).cast("array<string>")) if needs else out


def _runs(nodes: DataFrame, count: int, size: int, *order: str) -> DataFrame:
    """node, cell: runs of ``size`` nodes in that order; a task cuts many, as the driver samples rows for each range of a shuffle."""
    ranged = nodes.repartitionByRange(max(1, -(-count // max(size, RANGE_NODES))), *order).sortWithinPartitions(*order)
    # The range in the upper bits, then the row's place in it.
    at = F.monotonically_increasing_id()
    place = at.bitwiseAND(F.lit((1 << 33) - 1))
    return stored(ranged.select("node", (at - place + F.floor(place / size)).alias("cell")))


def cells_in_order(nodes: DataFrame, size: int = CELL_NODES) -> DataFrame:
    """node, cell: runs of about ``size`` nodes in the order of their names, for names that say where a node lies."""
    nodes = nodes.select("node").where("node IS NOT NULL").distinct()
    return _runs(nodes, nodes.count(), size, "node")


def cells_by_place(nodes: DataFrame, size: int = CELL_NODES) -> DataFrame:
    """node, cell of nodes (node, x, y): runs of about ``size`` nodes along a Z-curve, so that a cell's nodes lie together.

    The curve's steps are as long in y as in x: cells of a long and narrow network follow one another, and no path zigzags between two.
    """
    n, x0, x1, y0, y1 = nodes.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return cells_in_order(nodes, size)
    side = max(x1 - x0, y1 - y0, 1e-300)
    step = lambda c, lo: F.floor((F.col(c) - lo) / side * 65535).cast("long")
    x, y = step("x", x0), step("y", y0)
    code = F.lit(0).cast("long")
    for bit in range(16):
        for c, up in ((x, 0), (y, 1)):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1)), 2 * bit + up))
    return _runs(nodes.select("node", code.alias("code")), n, size, "code", "node")


def _blocks(cells: DataFrame, size: int) -> DataFrame:
    """node, cell: runs of cells in the order of their numbers, of about ``size`` nodes, as one."""
    count = cells.count()
    return stored(cells.repartitionByRange(max(1, -(-count // size)), "cell").select("node", F.spark_partition_id().alias("cell")))


@dataclass
class Cell:
    """The links that leave a cell's nodes; ``beyond`` has the cells of the heads that lie in others."""

    net: Network
    beyond: dict[int, int]
    names: list[str] = field(init=False)
    edges: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names, self.edges = self.net.nodes.tolist(), self.net.edges.tolist()

    def spread(self, labels: dict[str, tuple], limit: float) -> tuple[dict[int, float], dict[int, tuple]]:
        """Costs up to ``limit`` of the nodes reached from labels (cost, then how it was got), and how each was got.

        How: cost and link of the node before, that node and the link to here. Of equal costs the least of these holds,
        which is the rule of one search over the whole network: the node before that it settles first.
        """
        cost: dict[int, float] = {}
        got: dict[int, tuple] = {}
        heap = []
        for name, label in labels.items():
            if (at := self.net.node(name)) is not None and label[0] <= limit:
                cost[at], got[at] = label[0], label[1:]
                heap.append((label[0], at))
        heapq.heapify(heap)
        done: set[int] = set()
        start, heads, ids, weights = self.net.start, self.net.head, self.net.edge, self.net.weight
        while heap:
            d, at = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            row = slice(start[at], start[at + 1])
            by, own = got[at][3], self.names[at]
            for e, other, w in zip(ids[row].tolist(), heads[row].tolist(), weights[row].tolist(), strict=True):
                new, old = d + w, cost.get(other, math.inf)
                if new > limit or new > old:
                    continue
                how = (d, by, own, self.edges[e])
                if new < old:
                    cost[other], got[other] = new, how
                    heapq.heappush(heap, (new, other))
                elif how < got[other]:
                    got[other] = how
        return cost, got


HOW = "p_cost double, p_edge string, p_node string, edge string"
_LABEL = ["cost", "p_cost", "p_edge", "p_node", "edge"]


def _shuffled(cells: DataFrame) -> DataFrame:
    """A table of nodes that joins never send whole, through the driver: names in order take a byte or two each in its files, by which Spark judges it, and many times that in memory."""
    return cells.hint("merge")


def _cell_rows(edges: DataFrame, cells: DataFrame, directed: bool) -> DataFrame:
    """cell, data: each cell's ``Cell``, pickled; stored."""
    arcs = edges.select(F.col("e_id").cast("string").alias("e_id"), F.col("from_id").cast("string").alias("tail"), F.col("to_id").cast("string").alias("head"), F.col("weight").cast("double").alias("weight"))
    arcs = arcs.where("tail IS NOT NULL AND head IS NOT NULL AND weight IS NOT NULL")
    if not directed:
        arcs = arcs.union(arcs.select("e_id", "head", "tail", "weight"))
    cells = _shuffled(cells)
    arcs = arcs.join(cells.select(F.col("node").alias("tail"), "cell"), "tail").join(cells.select(F.col("node").alias("head"), F.col("cell").alias("head_cell")), "head")

    def build(table: pa.Table) -> pa.Table:
        c = table.to_pydict()
        net = Network.of(c["e_id"], c["tail"], c["head"], c["weight"], directed=True)
        mine = c["cell"][0]
        beyond = {net.node(h): k for h, k in zip(c["head"], c["head_cell"], strict=True) if k != mine}
        return pa.table({"cell": pa.array([mine], pa.int32()), "data": pa.array([pickle.dumps((net, beyond))], pa.binary())})

    return stored(arcs.select("cell", "e_id", "tail", "head", "weight", "head_cell").groupBy("cell").applyInArrow(build, "cell int, data binary"))


def _by_origin(table: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in table.to_pylist():
        out.setdefault(r["origin"], []).append(r)
    return out


def _spread(rows: pa.Table, cell: pa.Table) -> pa.Table:
    """What the labels of a cell give: labels of nodes of other cells (to: their cell), and costs of wanted nodes (to: null)."""
    out: list[tuple] = []
    if len(rows) and len(cell):
        mine = cell["cell"][0].as_py()
        c = Cell(*pickle.loads(cell["data"][0].as_py()))
        for origin, own in _by_origin(rows).items():
            labels = {r["node"]: tuple(r[k] for k in _LABEL) for r in own if not r["wanted"]}
            cost, got = c.spread(labels, min(r["bound"] for r in own))
            out += [(origin, c.names[at], mine, to, cost[at], *got[at]) for at, to in c.beyond.items() if at in cost]
            out += [(origin, r["node"], mine, None, cost[at], None, None, None, None) for r in own if r["wanted"] and (at := c.net.node(r["node"])) in cost]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string())
    names = ["origin", "node", "source", "to", *_LABEL]
    return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)


def _back(rows: pa.Table, cell: pa.Table) -> pa.Table:
    """The links of asked paths (wanted: they end at ``node``) within a cell, and where they enter it: node (null: at the origin), cell."""
    out: list[tuple] = []
    if len(rows) and len(cell):
        c = Cell(*pickle.loads(cell["data"][0].as_py()))
        for origin, own in _by_origin(rows).items():
            labels = {r["node"]: tuple(r[k] for k in _LABEL) for r in own if not r["wanted"]}
            sources = {r["node"]: r["source"] for r in own if not r["wanted"]}
            _, got = c.spread(labels, max(r["cost"] for r in own if r["wanted"]))
            for r in own:
                if not r["wanted"]:
                    continue
                piece, name = [], r["node"]
                while name != origin:
                    *_, before, edge = got[c.net.node(name)]
                    piece.append(edge)
                    if name in labels and got[c.net.node(name)] == labels[name][1:]:
                        break
                    name = before
                else:
                    before = None
                out.append((origin, r["destination"], before, sources[name] if before is not None else None, piece[::-1]))
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
    return pa.table([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["origin", "destination", "node", "cell", "piece"])


def _in_cells(rows: DataFrame, cells: DataFrame, parts: int, run, schema: str) -> DataFrame:
    """``run`` over each cell's rows, ``parts`` tasks a cell, all rows of an origin in one; cells without rows are not sent."""
    part = F.pmod(F.xxhash64("origin"), F.lit(parts)).cast("int")
    copies = cells.join(rows.select("cell").distinct(), "cell", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("part", part).groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInArrow(run, schema)


def cell_paths(od: DataFrame, edges: DataFrame, cells: DataFrame | None = None, directed: bool = False, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``least_cost_paths`` over a network that no worker holds: the same costs, to the last bit, and the same choice among equal ones.

    edges: e_id, from_id, to_id, weight above 0. cells: node, cell (``cells_by_place``, or else ``cells_in_order``); any cells give the
    same paths, cells of neighbours fewer rounds. Cells whose numbers follow one another are joined while they have about ``block_nodes``
    nodes at most, which cuts the rounds. A task holds one such block, and of up to about ORIGINS origins the labels of its border.

    Each round spreads the labels of the cells that got a better one, by a search within the cell, and sends labels to the
    nodes beyond its border. A label has the cost of a node, and of the node before it the cost and link, which decide ties. What a
    cell sends replaces what it sent before; a node's label is the least that any cell sends. Costs beyond the largest
    of an origin's destinations, once all are known, are not spread. When no label changes, paths are walked back cell by
    cell. A round is five checkpoints; the rounds are about as many as blocks on the longest path.
    """
    nodes = edges.select(F.col("from_id").cast("string").alias("node")).union(edges.select(F.col("to_id").cast("string")))
    own = [cells_in_order(nodes)] if cells is None else []
    cells = _blocks(own[0] if own else cells, block_nodes)
    own.append(cells)
    data = _cell_rows(edges, cells, directed)
    pairs = od.select(F.col("origin").cast("string").alias("origin"), F.col("destination").cast("string").alias("destination")).where("origin <> destination").distinct()
    ends = checkpointed(pairs.join(_shuffled(cells.withColumnsRenamed({"node": "destination"})), "destination"))
    origins = ends.select("origin").distinct().count()
    parts = max(1, -(-origins // ORIGINS), min(origins, od.sparkSession.sparkContext.defaultParallelism))
    infinite = F.lit(math.inf)

    def best(sent: DataFrame) -> DataFrame:
        least = F.min(F.struct(*_LABEL, "source")).alias("m")
        return sent.groupBy("origin", "node", F.col("to").alias("cell")).agg(least).select("origin", "node", "cell", "m.*")

    start = ends.select("origin").distinct().join(_shuffled(cells.select(F.col("node").alias("origin"), F.col("cell").alias("to"))), "origin")
    none = F.lit(None).cast("string")
    first = start.select("origin", F.col("origin").alias("node"), F.lit(None).cast("int").alias("source"), "to", F.lit(0.0).alias("cost"), F.lit(-1.0).alias("p_cost"), F.lit("").alias("p_edge"), none.alias("p_node"), F.lit("").alias("edge"))
    sent = checkpointed(first)
    labels = checkpointed(best(sent))
    changed = labels.select("origin", "cell").distinct()
    found = None
    while True:
        if found is None:
            bounds = ends.groupBy("origin").agg(infinite.alias("bound"))
        else:
            costs = found.select("origin", F.col("node").alias("destination"), "cost")
            bounds = ends.join(costs, ["origin", "destination"], "left").groupBy("origin").agg(F.max(F.coalesce("cost", infinite)).alias("bound"))
        wanted = ends.select("origin", F.col("destination").alias("node"), "cell", *[F.lit(None).cast(t).alias(c) for c, t in zip(_LABEL, ("double", "double", "string", "string", "string"), strict=True)], F.lit(True).alias("wanted"))
        rows = labels.select("origin", "node", "cell", *_LABEL, F.lit(False).alias("wanted")).union(wanted)
        out = checkpointed(_in_cells(rows.join(changed, ["origin", "cell"], "left_semi").join(bounds, "origin"), data, parts, _spread, f"origin string, node string, source int, to int, cost double, {HOW}"))
        again = changed.withColumnRenamed("cell", "source")
        kept = sent.join(again, ["origin", "source"], "left_anti")
        sent = checkpointed(kept.union(out.where("to IS NOT NULL").select(*kept.columns)))
        costs = out.where("to IS NULL").select("origin", "node", "cost")
        found = checkpointed((costs if found is None else found.union(costs)).groupBy("origin", "node").agg(F.min("cost").alias("cost")))
        new = checkpointed(best(sent))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("origin", "node", *_LABEL)]
        differ = new.alias("a").join(labels.alias("b"), [F.col("a.origin") == F.col("b.origin"), F.col("a.node") == F.col("b.node"), *same[2:]], "left_anti")
        # A label beyond what all of an origin's destinations cost changes nothing.
        changed = checkpointed(differ.join(bounds, "origin").where("cost <= bound").select("origin", "cell").distinct())
        labels = new
        if changed.isEmpty():
            break

    asked = ends.join(found.withColumnRenamed("node", "destination"), ["origin", "destination"])
    asked = checkpointed(asked.select("origin", "destination", F.col("destination").alias("node"), "cell", "cost"))
    costs, pieces, depth = asked.select("origin", "destination", "cost"), None, 0
    while not asked.isEmpty():
        goal = asked.select("origin", "destination", "node", "cell", "cost", *[F.lit(None).cast(t).alias(c) for c, t in zip(_LABEL[1:], ("double", "string", "string", "string"), strict=True)], F.lit(None).cast("int").alias("source"), F.lit(True).alias("wanted"))
        known = labels.select("origin", F.lit(None).cast("string").alias("destination"), "node", "cell", *_LABEL, "source", F.lit(False).alias("wanted"))
        rows = goal.union(known.join(asked.select("origin", "cell").distinct(), ["origin", "cell"], "left_semi").select(*goal.columns))
        step = checkpointed(_in_cells(rows, data, parts, _back, "origin string, destination string, node string, cell int, piece array<string>"))
        here = step.select("origin", "destination", F.lit(-depth).alias("place"), "piece")
        pieces = here if pieces is None else pieces.union(here)
        asked = checkpointed(step.where("node IS NOT NULL").join(costs, ["origin", "destination"]).select("origin", "destination", "node", "cell", "cost"))
        depth += 1
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"])
    found = costs.withColumn("path", F.array().cast("array<string>")) if pieces is None else costs.join(pieces.groupBy("origin", "destination").agg(F.flatten(ordered).alias("path")), ["origin", "destination"])
    discard(data, *own)
    found = found.select(F.col("origin").alias("__o"), F.col("destination").alias("__d"), "cost", "path")
    met = od.drop("cost", "path").join(found, (F.col("origin").cast("string") == F.col("__o")) & (F.col("destination").cast("string") == F.col("__d")), "left")
    return met.withColumn("path", F.coalesce("path", F.array().cast("array<string>"))).drop("__o", "__d")
