"""Paths cell by cell are those of one search over the whole network; paths outlive the loss of links that they do not need."""

import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import network, paths

LINK = "e_id string, from_id string, to_id string, weight double"


def grid(w, h, weight, seed=0):
    """A grid of w times h nodes with a link to each neighbour, and some parallel ones."""
    rng = random.Random(seed)
    name = lambda x, y: f"{x:03d}_{y:03d}"
    out = []
    for x in range(w):
        for y in range(h):
            for a, b in ((x + 1, y), (x, y + 1)):
                if a < w and b < h:
                    out += [(f"e{rng.random():.9f}", name(x, y), name(a, b), weight(rng)) for _ in range(1 + (rng.random() < 0.1))]
    return out, name


@pytest.mark.parametrize("weight,directed,by_place", [
    (lambda r: 1.0, False, True), (lambda r: float(r.randint(1, 4)), False, False), (lambda r: r.random() + 0.1, True, True), (lambda r: float(r.randint(1, 2)), True, False),
])
def test_GR2_cells_equal_whole(spark, weight, directed, by_place):
    rows, name = grid(17, 13, weight, 3)
    if directed:  # and links back, of other weights
        rng = random.Random(8)
        rows += [(f"r{e}", b, a, weight(rng)) for e, a, b, _ in rows if rng.random() < 0.6]
    edges = spark.createDataFrame([*rows, ("lonely", "zz1", "zz2", 1.0), ("null", None, "zz1", 1.0)], LINK)
    rng = random.Random(4)
    place = lambda: name(rng.randrange(17), rng.randrange(13))
    pairs = [(o, place()) for o in (place() for _ in range(9)) for _ in range(5)] + [("zz1", "000_000"), ("zz2", "zz1"), ("000_000", "000_000"), ("nowhere", "000_000"), (None, "000_000")]
    od = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate([*pairs, pairs[0]])], "origin string, destination string, flow double")
    nodes = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")).where("node IS NOT NULL").distinct()
    place_of = F.split("node", "_")
    cells = paths.cells_by_place(nodes.select("node", F.coalesce(F.try_element_at(place_of, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.try_element_at(place_of, F.lit(2)).try_cast("double"), F.lit(0.0)).alias("y")), 40) if by_place else paths.cells_in_order(nodes, 40)
    assert 4 <= cells.select("cell").distinct().count() <= 12 and cells.count() == nodes.count()
    want = {(r.flow, r.origin, r.destination): (r.cost, r.path) for r in network.least_cost_paths(od, edges, directed).collect()}
    got = {(r.flow, r.origin, r.destination): (r.cost, r.path) for r in paths.cell_paths(od, edges, cells, directed).collect()}
    assert got == want and sum(c is not None for c, _ in got.values()) >= 45


@pytest.mark.parametrize("directed,block_nodes", [(False, 40), (True, 100)])
def test_blocks_of_cells_equal_whole(spark, directed, block_nodes):
    """Blocks of a cell and of several cells, so that paths cross their borders."""
    rng = random.Random(9)
    rows, name = grid(17, 13, lambda r: float(r.randint(1, 3)) if directed else r.random() + 0.1, 5)
    edges = spark.createDataFrame([*rows, *[(f"r{e}", b, a, w + 1) for e, a, b, w in rows if directed]], LINK)
    pairs = {(name(rng.randrange(17), rng.randrange(13)), name(rng.randrange(17), rng.randrange(13))) for _ in range(30)}
    od = spark.createDataFrame(sorted(p for p in pairs if p[0] != p[1]), "origin string, destination string")
    cells = paths.cells_in_order(edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")), 40)
    assert paths._blocks(cells, block_nodes).select("cell").distinct().count() > 1
    key = lambda df: sorted((r.origin, r.destination, r.cost, r.path) for r in df.collect())
    assert key(paths.cell_paths(od, edges, cells, directed, block_nodes)) == key(network.least_cost_paths(od, edges, directed))


def test_cells_of_a_strip_follow_one_another(spark):
    """Steps as long in y as in x: a strip's cells are whole rows, where the sides' own scales cut it along its length."""
    nodes = spark.range(4 * 400).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("node"), (F.col("id") % 4).cast("double").alias("x"), F.floor(F.col("id") / 4).cast("double").alias("y"))
    spans = paths.cells_by_place(nodes, 100).join(nodes, "node").groupBy("cell").agg((F.max("y") - F.min("y") + 1).alias("rows")).agg(F.count("*").alias("cells"), F.sum("rows").alias("rows")).first()
    assert 12 <= spans.cells <= 20 and spans.rows < 400 + 10 * spans.cells


def test_cells_are_cut_within_ranges(spark):
    """Many small cells are no ranges of a shuffle each, of which the driver would hold samples: a task numbers those of its own."""
    nodes = spark.range(400).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("node"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    for cells in (paths.cells_by_place(nodes, 2), paths.cells_in_order(nodes, 2)):
        assert len(cells.inputFiles()) <= 2
        rows = [r.cell for r in cells.orderBy("node").collect()]
        assert rows == sorted(rows) and rows[::2] == rows[1::2] and len(set(rows)) == 200


def test_tables_of_nodes_are_not_sent_whole(spark, monkeypatch):
    """Joins with the cells, whose files are much shorter than their rows in memory, do not pass them through the driver."""
    rows, _ = grid(5, 4, lambda r: 1.0)
    edges = spark.createDataFrame(rows, LINK)
    cells = paths.cells_in_order(edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")), 5)
    plans = []
    monkeypatch.setattr(paths, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert paths._cell_rows(edges, cells, False).count() == 4
    assert plans[0].count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plans[0]


def test_find_paths_goes_by_size(spark):
    rows, name = grid(6, 6, lambda r: float(r.randint(1, 3)))
    edges = spark.createDataFrame(rows, LINK)
    od = spark.createDataFrame([(name(0, 0), name(5, 5)), (name(1, 2), name(4, 0))], "origin string, destination string")
    small, large = (sorted(map(tuple, paths.find_paths(od, edges, needs=True, whole_links=n).select("origin", "destination", "cost", "path").collect())) for n in (1000, 10))
    assert small == large and paths.find_paths(od, edges, needs=True, whole_links=10).where("needs IS NOT NULL").count() == 0


@pytest.mark.parametrize("weights,directed", [((1, 1), False), ((1, 3), False), ((1, 2), True)])
def test_GR4_paths_outlive_what_they_do_not_need(weights, directed):
    rows, name = grid(9, 9, lambda r: float(r.randint(*weights)), 1)
    net = lambda rs: network.Network.of([r[0] for r in rs], [r[1] for r in rs], [r[2] for r in rs], [r[3] for r in rs], directed)
    rng, kept, lost = random.Random(2), 0, 0
    for _ in range(60):
        o, d = name(rng.randrange(5), rng.randrange(5)), name(4 + rng.randrange(5), 4 + rng.randrange(5))
        before = net(rows).tree(o, {d}, needs=True).get(d)
        gone = {r[0] for r in rng.sample(rows, 12)}
        after = net([r for r in rows if r[0] not in gone]).tree(o, {d}).get(d)
        if before and not gone & set(before[2]):
            kept += 1
            assert after[:2] == before[:2]
        else:
            lost += 1
        assert before is None or set(before[1]) <= set(before[2])
    assert kept > 3 and lost > 3


def test_CP4_CP5_stored_index(spark, tmp_path):
    """Only the damaged links' buckets are read, no path is exploded, and the candidates are those of the index in memory."""
    from roadweave.operators import incidence as inc
    from roadweave.operators import path_index

    rng = random.Random(6)
    rows = [(i, float(i % 5), [f"e{rng.randrange(40)}" for _ in range(rng.randint(0, 6))]) for i in range(200)] + [(900 + i, 1.0, ["hot", "e1", "hot"]) for i in range(60)]
    df = spark.createDataFrame(rows, "od_id long, flow double, path array<string>")
    damaged = spark.createDataFrame([("a", "e1"), ("a", "e1"), ("a", "hot"), ("b", "e7"), ("b", None), ("c", "nowhere")], "event string, e_id string")
    folder = f"file://{tmp_path}/index"
    for _ in range(2):  # an index is replaced
        path_index.write_path_index(df, folder, 16)
    got = path_index.stored_candidates(spark, folder, damaged)
    key = lambda r: (r.event, r.path_id)
    want = sorted(inc.index_candidates(inc.path_index(df), damaged.distinct()).collect(), key=key)
    assert sorted(got.collect(), key=key) == want and len(want) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "PartitionFilters: [bucket" in plan
    path_index.write_path_index(df.limit(0), folder, 16)
    assert path_index.stored_candidates(spark, folder, damaged).count() == 0
