"""Networks: nodes, components, least-cost paths, edge initialisation."""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from .spatial import line_length, snap, split_lines
from ..session import checkpointed


def edge_init(links: DataFrame) -> DataFrame:
    """Tier, break point, free-flow and least speed, daily capacity and the state columns of links with road_class, lanes, urban."""
    out = links.withColumn("tier", cost.tier(F.col("road_class")))
    t = F.col("tier")
    own = F.col("free_flow_speed") if "free_flow_speed" in links.columns else F.lit(None).cast("double")
    per_lane = F.coalesce(F.col("flow_cap_plph"), cost.tier_value(t, 0)) if "flow_cap_plph" in links.columns else cost.tier_value(t, 0)
    given = [F.col(c) for c in ("AB_FinalSpeed", "BA_FinalSpeed", "Speed_Limit") if c in links.columns]
    speed = cost.free_flow(own, given, t, F.col("urban"))
    return out.withColumns({"breakpoint": cost.tier_value(t, 1), "min_speed": cost.tier_value(t, 4), "initial_speed": speed, "acc_speed": speed, "acc_capacity": per_lane * F.col("lanes") * 24, "acc_flow": F.lit(0.0)})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that links lead to, in either direction.

    The rounds grow with the logarithm of the longest path, whatever the nodes' names (``connected_components``).
    """
    from ..llm.components import connected_components  # here, as the network must load without the corpus operators

    return connected_components(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))


@dataclass
class Network:
    """Links by node in flat arrays: those of node i are at start[i] to start[i + 1], in the order of their ids."""

    nodes: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    head: np.ndarray
    edge: np.ndarray
    weight: np.ndarray
    directed: bool = False

    @classmethod
    def of(cls, edge: list[str], tail: list[str], head: list[str], weight: list[float] | np.ndarray, directed: bool = False) -> Network:
        """Undirected links lead both ways."""
        edges, e = np.unique(np.array(edge, object).astype(str), return_inverse=True) if len(edge) else (np.empty(0, str), np.empty(0, int))
        ends = np.array([*tail, *head], object).astype(str)
        nodes, at = np.unique(ends, return_inverse=True) if len(ends) else (ends, np.empty(0, int))
        a, b, w = at[: len(edge)], at[len(edge) :], np.asarray(weight, float)
        if not directed:
            a, b, e, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([e, e]), np.concatenate([w, w])
        order = np.lexsort((b, e, a))
        return cls(nodes, edges, np.searchsorted(a[order], np.arange(len(nodes) + 1)), b[order].astype(np.int32), e[order].astype(np.int32), w[order], directed)

    def node(self, name: str) -> int | None:
        at = int(np.searchsorted(self.nodes, name))
        return at if at < len(self.nodes) and self.nodes[at] == name else None

    @functools.cached_property
    def into(self) -> Network:
        """The same links by the node that they lead to."""
        if not self.directed:
            return self
        order = np.argsort(self.head, kind="stable")
        tail = np.repeat(np.arange(len(self.nodes), dtype=np.int32), np.diff(self.start))
        return Network(self.nodes, self.edges, np.searchsorted(self.head[order], np.arange(len(self.nodes) + 1)), tail[order], self.edge[order], self.weight[order], True)

    def tree(self, origin: str, wanted: set[str], needs: bool = False) -> dict[str, tuple[float, list[str], list[str]]]:
        """Cost and edges to each wanted node that can be reached, and with ``needs`` the edges on which both depend.

        Of equal costs that holds whose node before is nearer, or else was itself reached by the smaller edge, or has the
        smaller name. A path stays what it is while the edges that it needs stay, whatever others are lost: its own and, where
        another node before would cost as much and lie as near, those that this node was reached by.
        """
        source = self.node(origin)
        ends = {n: w for w in wanted if w != origin and (n := self.node(w)) is not None}
        if source is None or not ends:
            return {}
        cost_of, before, done = {source: 0.0}, {}, set()
        heap, left, start = [(0.0, -1, source)], set(ends) - {source}, self.start
        while heap and left:
            d, _, node = heapq.heappop(heap)
            if node in done:
                continue
            done.add(node)
            left.discard(node)
            row = slice(start[node], start[node + 1])
            for e, other, w in zip(self.edge[row].tolist(), self.head[row].tolist(), self.weight[row].tolist(), strict=True):
                if other not in done and d + w < cost_of.get(other, math.inf):
                    cost_of[other], before[other] = d + w, (node, e)
                    heapq.heappush(heap, (d + w, e, other))
        out = {}
        for node in ends.keys() & done:
            path, at = [], node
            while at != source:
                at, e = before[at]
                path.append(str(self.edges[e]))
            out[ends[node]] = cost_of[node], path[::-1], self._needs(node, source, cost_of, before, done) if needs else []
        return out

    def _needs(self, node: int, source: int, cost_of: dict[int, float], before: dict[int, tuple[int, int]], done: set[int]) -> list[str]:
        back, seen, todo, out = self.into, {source}, [node], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            first, e = before[at]
            out.add(e)
            todo.append(first)
            row = slice(back.start[at], back.start[at + 1])
            todo += [u for u, w in zip(back.head[row].tolist(), back.weight[row].tolist(), strict=True) if u in done and cost_of[u] == cost_of[first] and cost_of[u] + w == cost_of[at]]
        return [str(self.edges[e]) for e in sorted(out)]


def least_cost_paths(od: DataFrame, edges: DataFrame, directed: bool = False, needs: bool = False) -> DataFrame:
    """od with cost double and path array<e_id>, and with ``needs`` the edges that decide it; unreachable and self pairs have a null cost and an empty path.

    edges: e_id, from_id, to_id, weight. The network goes to every worker as arrays, some 60 bytes a link and its names; demand
    is dealt by origin, so an origin's tree is grown once. The result is a checkpoint, after which the network is let go.
    """
    spark = od.sparkSession
    rows = edges.select(F.col("e_id").cast("string"), F.col("from_id").cast("string"), F.col("to_id").cast("string"), F.col("weight").cast("double")).where("from_id IS NOT NULL AND to_id IS NOT NULL AND weight IS NOT NULL").toArrow()
    net = spark.sparkContext.broadcast(Network.of(rows[0].to_pylist(), rows[1].to_pylist(), rows[2].to_pylist(), rows[3].to_numpy(), directed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None, None)
        for pdf in batches:
            for origin, mine in pdf.groupby("origin", sort=False, dropna=False):
                wanted = set(mine["destination"].dropna())
                # Rows come sorted by origin: its tree is kept while it lasts, and grown again only for further ends.
                if last[0] != origin or not wanted <= last[1]:
                    last = origin, wanted, net.value.tree(origin, wanted, needs) if isinstance(origin, str) else {}
                found = [last[2].get(d, (None, [], [])) for d in mine["destination"]]
                more = {"needs": [n for *_, n in found]} if needs else {}
                yield mine.assign(cost=[c for c, *_ in found], path=[p for _, p, _ in found], **more)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in od.schema.fields)
    out = checkpointed(od.repartition("origin").sortWithinPartitions("origin").mapInPandas(run, f"{kinds}, cost double, path array<string>{', needs array<string>' if needs else ''}"))
    net.destroy()
    return out


def nodes_of(links: DataFrame, digits: int = 6) -> DataFrame:
    """node_id (the rounded coordinates as text), x, y: the ends of the links' vertices array<struct<x, y>>.

    An id depends on the place alone, so it needs no numbering in one task and is the same in every table.
    """
    ends = links.select(F.explode(F.array(F.col("vertices")[0], F.element_at("vertices", -1))).alias("p")).select(F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    return ends.withColumn("node_id", node_id(F.col("x"), F.col("y"), digits))


def node_id(x: Column, y: Column, digits: int = 6) -> Column:
    return F.concat_ws("_", F.round(x, digits).cast("string"), F.round(y, digits).cast("string"))


def with_topology(links: DataFrame) -> DataFrame:
    """Links with from_id and to_id: ANODE and BNODE if the table has them, else the ids of the line's ends."""
    if {"ANODE", "BNODE"} <= set(links.columns):
        return links.withColumns({"from_id": F.col("ANODE").cast("string"), "to_id": F.col("BNODE").cast("string")})
    a, b = F.col("vertices")[0], F.element_at("vertices", -1)
    return links.withColumns({"from_id": node_id(a["x"], a["y"]), "to_id": node_id(b["x"], b["y"])})


def network_of_parts(lines: DataFrame, points: DataFrame, reach: float | None = None, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) of lines (e_id, vertices) that are cut where points (id, x, y) lie nearest to them, within ``reach``.

    links: e_id (with _ and its number where a line was cut), line, piece, vertices, from_id, to_id; nodes: ``nodes_of`` them.
    A line's piece has the next one's from_id as its to_id, so a point has links on both sides.
    """
    pieces = split_lines(lines, snap(points, lines, reach).select("e_id", "place"))
    several = pieces.where("piece = 1").select("e_id", F.lit(True).alias("several"))
    own = F.when(F.col("several"), F.concat_ws("_", "line", "piece")).otherwise(F.col("line"))
    links = pieces.join(several, "e_id", "left").withColumnRenamed("e_id", "line").withColumn("e_id", own).select("e_id", "line", "piece", "vertices")
    a, b = F.col("vertices")[0], F.element_at("vertices", -1)
    links = checkpointed(links.withColumns({"from_id": node_id(a["x"], a["y"], digits), "to_id": node_id(b["x"], b["y"], digits)}))
    return links, nodes_of(links, digits)


def select_links(links: DataFrame, nodes: DataFrame, column: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links of some kinds as e_id, from_id, to_id and the rest, and the nodes that they touch."""
    kept = links.where(F.col(column).isin(values)).withColumnsRenamed({"id": "e_id", "start_node": "from_id", "end_node": "to_id"})
    used = kept.select(F.col("from_id").alias("id")).union(kept.select("to_id")).distinct()
    return kept, nodes.join(used, "id", "left_semi")


# What the freight network's class codes stand for, by class.
CLASS_CODES = {
    "motorway": (1, 11, 13, 33), "trunk": (2, 12), "primary": (3, 4, 14, 23), "secondary": (5,), "tertiary": (6, 15), "unclassified": (7,),
    "motorway_link": (8, 21, 22), "service": (9, 16, 17, 18, 19, 36, 41), "centroid_connector": (50,),
}
# Labels of the codes in reports.
CODE_LABELS = {
    1: "Interstate", 2: "Principal Arterial - Freeways and Expressways", 3: "Principal Arterial - Other", 4: "Minor Arterial", 5: "Major Collector", 6: "Minor Collector", 7: "Local", 8: "Ramp",
    9: "Service/Frontage Road", 11: "Interstate Highway", 12: "Other Controlled Access Highway", 13: "Non-Freeway Interstate (Alaska)", 14: "Arterial or Major Collector", 15: "Local Road",
    16: "Frontage/Service Road", 17: "Traffic Circle", 18: "Turn Lane", 19: "Facility Access/Circulator", 21: "System Ramp", 22: "Ramp", 23: "Collector/Distributor Lane", 33: "Express Lane (Truck)",
    36: "Administrative/Service Road", 41: "Ferry", 50: "Centroid Connector",
}
# Metres a mile, the code of rural places, lanes where none are known, metres a lane.
MILE, RURAL, LANES, LANE_WIDTH, CONNECTOR = 1609.34, 99999, 2, 3.5, 50


def class_of_code(code: Column) -> Column:
    out = F.lit("unclassified")
    for name, codes in CLASS_CODES.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def label_of_code(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in CODE_LABELS.items() for x in (k, v)]), code.cast("int"))


def without_connectors(links: DataFrame) -> DataFrame:
    """Links other than centroid connectors; a link without a code stays."""
    return links.where(F.coalesce(F.col("Class") != CONNECTOR, F.lit(True)))


def centroid_nodes(nodes: DataFrame, state: int) -> DataFrame:
    return nodes.where((F.col("Centroid") == 1) & (F.col("StateID") == state))


def in_states(links: DataFrame, states: str | list[str] | None) -> DataFrame:
    """Links of one or more states; all if none is named or the table has no STATE."""
    if states is None or "STATE" not in links.columns:
        return links
    return links.where(F.col("STATE").isin([states] if isinstance(states, str) else states))


def convert_links(links: DataFrame, states: str | list[str] | None = None) -> DataFrame:
    """A freight network's links (ID, and what of Class, Class_Description, LENGTH, AB_Lanes, BA_Lanes, Urban_Code, ... it has) as assignment links."""
    rows = with_topology(in_states(without_connectors(links) if "Class" in links.columns else links, states))
    has = set(links.columns)
    lanes = [F.col(c) for c in ("AB_Lanes", "BA_Lanes") if c in has]
    n = F.coalesce((F.greatest(*lanes) if len(lanes) == 2 else lanes[0]) if lanes else F.lit(None), F.lit(LANES)).cast("int")
    road = class_of_code(F.col("Class")) if "Class" in has else F.lit("unclassified")
    own = F.nullif(F.trim("Class_Description"), F.lit("")) if "Class_Description" in has else F.lit(None).cast("string")
    detail = F.coalesce(own, label_of_code(F.col("Class")), road) if "Class" in has else F.lit("unclassified")
    more = [c for c in ("Road_Name", "STATE", "County_Name", "FAFZONE", "Speed_Limit", "AB_FinalSpeed", "BA_FinalSpeed", "vertices") if c in has]
    return rows.select(
        F.col("ID").cast("string").alias("e_id"), "from_id", "to_id", (F.col("LENGTH") * MILE if "LENGTH" in has else line_length(F.col("vertices"))).alias("length"), road.alias("road_class"), detail.alias("road_class_detail"),
        n.alias("lanes"), ((F.col("Urban_Code") != RURAL).cast("int") if "Urban_Code" in has else F.lit(0)).alias("urban"), (n * LANE_WIDTH).alias("width"), F.lit(0.0).alias("toll"), F.lit("no").alias("road_bridge"), F.lit("faf5").alias("network_source"), *more,
    )


def source_of(links: DataFrame, named: str | None = None) -> str:
    """Where a network is from: as named, else the commonest network_source, else by its columns."""
    if named:
        return named.strip().lower()
    if "network_source" in links.columns:
        top = links.where("network_source IS NOT NULL").groupBy(F.lower("network_source").alias("s")).count().orderBy(F.desc("count"), "s").first()
        if top:
            return top["s"]
    if {"tntp_capacity", "tntp_capacity_vph", "tntp_t0", "tntp_free_flow_time"} & set(links.columns):
        return "tntp"
    return "osm" if "highway" in links.columns else "faf5"


def normalise_links(links: DataFrame, named: str | None = None) -> DataFrame:
    """Links with network_source, road_class (cleaned), tier and damage_profile, whatever the source calls its classes."""
    source = source_of(links, named)
    column = next((c for c in (("network_class", "highway", "road_class") if source == "osm" else ("network_class", "road_class")) if c in links.columns), None)
    if column is None:
        raise ValueError("links need road_class or highway")
    c = cost.clean_class(F.col(column))
    c = F.when(c.isin("", "nan", "none", "null"), "unclassified").otherwise(F.regexp_replace(c, "_link$", "") if source == "osm" else c)
    out = links.withColumns({"network_source": F.lit(source), "road_class": c})
    return out.withColumns({"tier": cost.tier(F.col("road_class")), "damage_profile": F.when(cost.is_major(F.col("road_class")), "major_road").otherwise("minor_road")})
