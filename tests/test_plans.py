"""Iterated plans against small networks worked out by hand, and kernels against invariants."""

import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import cost, damage, keys
from roadweave.operators import demand, exposure, network, report, spatial
from roadweave.operators import incidence as inc
from roadweave.plans import assignment
from roadweave.sources import tables

PARALLEL = [("e_fast", "n1", "n2", 10000.0, 70.0), ("e_mid", "n1", "n2", 10000.0, 50.0), ("e_slow", "n1", "n2", 10000.0, 30.0)]
DIAGONAL = math.hypot(5000, 5000)
BRAESS = [("e_12", "1", "2", DIAGONAL, 45.0), ("e_13", "1", "3", DIAGONAL, 15.0), ("e_23", "2", "3", 10000.0, 80.0), ("e_24", "2", "4", DIAGONAL, 5.0), ("e_34", "3", "4", DIAGONAL, 45.0)]


def net(spark, rows):
    df = spark.createDataFrame(rows, "e_id string, from_id string, to_id string, metres double, mph double")
    return df.select("e_id", "from_id", "to_id", cost.link_cost(F.col("metres"), F.col("mph"), F.lit(0.0)).alias("weight"), F.lit(24.0).alias("capacity"))


def od(spark, rows):
    return spark.createDataFrame(rows, "origin string, destination string, flow double")


@pytest.mark.parametrize("rows,pair,flow,closed,base,change", [
    (PARALLEL, ("n1", "n2"), 100.0, "e_fast", {"e_fast": 24, "e_mid": 24, "e_slow": 24}, -95.27435151515712),
    (PARALLEL, ("n1", "n2"), 30.0, "e_fast", {"e_fast": 24, "e_mid": 6, "e_slow": 0}, 25.071499098705655),
    (BRAESS, ("1", "4"), 12.0, "e_23", {"e_12": 12, "e_13": 0, "e_23": 12, "e_24": 0, "e_34": 12}, 5.160587707273884),
    (BRAESS, ("1", "4"), 13.0, "e_23", {"e_12": 13, "e_13": 0, "e_23": 13, "e_24": 0, "e_34": 13}, 5.5906366828800245),
])
def test_CP3_CP21_golden(spark, rows, pair, flow, closed, base, change):
    done = assignment.capacity_loop(od(spark, [(*pair, flow)]), net(spark, rows))
    assert {r.e_id: r.acc_flow for r in done.links.collect()} == pytest.approx(base)
    assert done.isolated.agg(F.coalesce(F.sum("flow"), F.lit(0.0))).first()[0] == pytest.approx(max(0, flow - 72) if len(rows) == 3 else 0)
    got, _ = assignment.reroute(done, spark.createDataFrame([(closed,)], "e_id string"))
    assert got == pytest.approx(change, rel=1e-9)


def test_JN5_isolated_ends_and_self_pairs(spark):
    done = assignment.capacity_loop(od(spark, [("n1", "zz", 5.0), (None, "n2", 1.0), ("n1", "n1", 2.0), ("n1", "n2", 3.0)]), net(spark, PARALLEL))
    assert done.paths.count() == 1 and sorted(r.flow for r in done.isolated.collect()) == [1.0, 2.0, 5.0]
    assert assignment.capacity_loop(od(spark, []), net(spark, PARALLEL)).iterations == 0


def plain_equilibrium(od, links, iterations):
    """The rule on lists: link flows and gaps after so many iterations."""
    flow, gaps = dict.fromkeys((e[0] for e in links), 0.0), []
    time = lambda: {e: t0 if c <= 0 or flow[e] <= 0 else t0 * (1 + 0.15 * (flow[e] / c) ** 4) for e, _, _, t0, c in links}
    for k in range(1, iterations + 2):
        t = time()
        net = network.Network.of([e[0] for e in links], [e[1] for e in links], [e[2] for e in links], [t[e[0]] for e in links], directed=True)
        load, least = dict.fromkeys(flow, 0.0), 0.0
        for o, d, f in od:
            if found := net.tree(o, {d}).get(d):
                least += f * found[0]
                for e in found[1]:
                    load[e] += f
        if k > 1:
            gaps.append(max(0.0, 1 - least / sum(flow[e] * t[e] for e in flow)))
        if k <= iterations:
            step = 1.0 if k == 1 else 2 / (k + 2)
            flow = {e: flow[e] + step * (load[e] - flow[e]) for e in flow}
    return flow, gaps


UE = "e_id string, from_id string, to_id string, t0 double, capacity double"


def test_GR7_equilibrium_has_equal_times(spark):
    links = spark.createDataFrame([("a", "1", "2", 10.0, 10.0), ("b", "1", "2", 15.0, 30.0)], UE)
    got = assignment.user_equilibrium(od(spark, [("1", "2", 30.0), ("1", "2", 10.0), ("2", "1", 5.0), ("1", "1", 7.0)]), links, 40, 1e-3, search=True)
    row = {r.e_id: r for r in got.links.collect()}
    assert got.converged and got.history[-1] <= 1e-3 and got.iterations == len(got.history) < 40
    assert row["a"].time == pytest.approx(row["b"].time, rel=0.02) and row["a"].flow + row["b"].flow == pytest.approx(40)
    none = assignment.user_equilibrium(od(spark, []), links)
    assert none.history == [0.0] and none.links.agg(F.sum("flow")).first()[0] == 0


def test_GR7_flows_and_gaps_by_the_rule(spark):
    """A ring of 12 places with chords; every iteration's gap and the flows at the end are those of the rule on lists."""
    n = 12
    rows = [(f"{k}{a:02d}_{b:02d}", f"p{a:02d}", f"p{b:02d}", 2.0 + (7 * a + 3 * b) % 5 + 0.37 * k, 20.0 + (a * b) % 7) for a in range(n) for k, b in enumerate(((a + 1) % n, (a - 1) % n, (a + 5) % n))]
    trips = [(f"p{a:02d}", f"p{b:02d}", 1.0 + (a * 5 + b) % 4) for a in range(0, n, 3) for b in range(n) if a != b]
    got = assignment.user_equilibrium(od(spark, trips), spark.createDataFrame(rows, UE), 5, 0.0)
    flow, gaps = plain_equilibrium(trips, rows, 5)
    assert got.history == pytest.approx(gaps, abs=1e-9) and not got.converged
    assert {r.e_id: r.flow for r in got.links.collect()} == pytest.approx(flow, abs=1e-9)
    best = assignment.user_equilibrium(od(spark, trips), spark.createDataFrame(rows, UE), 5, 0.0, search=True)
    assert best.history[-1] < gaps[-1]


def test_CP21_GR4_only_trees_that_lost_a_link_are_grown_again(spark, monkeypatch):
    """A net with local demand: the same assignment and the same recovery table, with under a third of the trees."""
    from roadweave.plans import recovery

    w, h = 14, 8
    name = lambda x, y: f"{x:02d}_{y:02d}"
    links = [(f"{x:02d}_{y:02d}{k}", name(x, y), name(a, b), 400.0 + (x * 37 + y * 91 + 13 * k) % 700, 30.0 + (x * 5 + y * 3) % 40) for x in range(w) for y in range(h) for k, (a, b) in enumerate(((x + 1, y), (x, y + 1))) if a < w and b < h]
    trips = [(name(x, y), name(min(x + 1 + (x + y) % 3, w - 1), min(y + 1 + (x * y) % 2, h - 1)), 40.0 + (x * y) % 60) for x in range(0, w - 1, 2) for y in range(0, h - 1, 2)]
    plain = spark.createDataFrame(links, "e_id string, from_id string, to_id string, metres double, capacity double")
    base = plain.withColumn("weight", F.col("metres")).drop("metres")
    kept = assignment.capacity_loop(od(spark, trips), base, 3)
    with monkeypatch.context() as m:
        m.setattr(assignment, "still_good", lambda ways, gone: ways.limit(0))
        whole = assignment.capacity_loop(od(spark, trips), base, 3)
    flows = lambda a: {r.e_id: round(r.acc_flow, 6) for r in a.links.collect()}
    assert flows(kept) == flows(whole) and kept.cost == pytest.approx(whole.cost) and kept.iterations == whole.iterations == 3
    assert kept.trees[0] == whole.trees[0] and sum(kept.trees[1:]) < sum(whole.trees[1:]), (kept.trees, whole.trees)

    paths = kept.paths.where("iteration = 0").select(F.lit("v").alias("event"), "od_id", "origin", "destination", "flow", F.slice("path", 1, 1).alias("hits"), "path")
    state = plain.select("e_id", "from_id", "to_id", "metres", F.lit(0.0).alias("toll"), F.lit(50.0).alias("initial_speed"), F.lit(5.0).alias("min_speed"), F.lit(1e9).alias("breakpoint"), F.lit(0.03).alias("congestion"), F.lit(0.0).alias("current_flow"),
        (F.col("capacity") * 40).alias("current_capacity"), F.when(F.substring("e_id", 1, 2) < "03", 0.0).alias("max_speed"), F.when(F.substring("e_id", 1, 2) < "03", "severe").otherwise("no").alias("level"), F.lit("road").alias("asset"), F.lit(0.0).alias("depth"))
    days = [(1, 1), (1, 3), (1, 4), (1, 5)]
    rates = spark.createDataFrame([("road", "severe", 1, 0.0), *[("road", "severe", k, 0.015 + k / 1000) for k in (2, 3, 4)]], "asset string, level string, day int, rate double")
    counted = []
    loop = assignment.capacity_loop
    monkeypatch.setattr(assignment, "capacity_loop", lambda *a, **k: counted.append(out := loop(*a, **k)) or out)
    table = [tuple(r) for r in recovery.recovery_table(state, {"m": paths}, rates, days).collect()]
    grown, counted[:] = sum(sum(a.trees) for a in counted), []
    monkeypatch.setattr(assignment, "still_good", lambda ways, gone: ways.limit(0))
    monkeypatch.setattr(assignment, "capacity_loop", lambda od, links, known=None: counted.append(out := loop(od, links)) or out)
    again = [tuple(r) for r in recovery.recovery_table(state, {"m": paths}, rates, days).collect()]
    assert [r[:3] for r in table] == [r[:3] for r in again] and [x for r in table for x in r[3:]] == pytest.approx([x for r in again for x in r[3:]])
    assert all(r[7] == pytest.approx(sum(r[9:])) for r in table)
    all_trees = sum(sum(a.trees) for a in counted)
    assert len(table) == 4 and all(r[3] > 0 for r in table) and table[0][7] != 0
    assert 0 < 3 * grown < all_trees, (grown, all_trees)


def test_JN30_pieces_add_up(spark):
    line = [(0.2, 0.1), (3.7, 2.9), (3.7, -1.2), (1.0, -1.0)]
    pieces = spatial.split_line(line, 0, 0, 1, 1)
    assert sum(n for *_, n in pieces) == pytest.approx(sum(math.dist(a, b) for a, b in zip(line, line[1:])))
    assert pieces[0][:2] == (0, 0) and (3, 2) in [p[:2] for p in pieces]
    links = spark.createDataFrame([("e", [{"x": x, "y": y} for x, y in line])], "e_id string, vertices array<struct<x double, y double>>")
    cells = spark.createDataFrame([(0, 0, 5.0)], "col int, row int, value double")
    out = spatial.intersect_grid(links, cells, 0, 0, 1, 1).collect()
    assert len(out) == len(pieces) and {r.value for r in out} == {5.0, None}
    assert links.select(spatial.line_length(F.col("vertices")).alias("n")).first().n == pytest.approx(sum(math.dist(a, b) for a, b in zip(line, line[1:])))
    assert spatial.in_box(links, 3, 2, 9, 9).count() == 1 and spatial.in_box(links, 5, 5, 9, 9).count() == 0


def test_JN28_polygon_and_fields(spark):
    p = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.9, 0.95)], "x double, y double")
    inside = p.where(spatial.in_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 0), (0, 1)])).collect()
    assert inside == []  # (0.5, 0.5) lies on the slanted side, whose points count as outside; (0.9, 0.95) lies beyond it
    assert p.where(spatial.in_polygon(F.col("x"), F.col("y"), [(0, 0), (1.1, 0), (0, 1.1)])).count() == 1
    assert p.where(spatial.in_polygon(F.col("x"), F.col("y"), [(0, 0), (1, 0), (1, 1), (0, 1)])).count() == 2
    row = p.select(spatial.hotspot(F.col("x"), F.col("y"), 0.5, 0.5, 9.0, 1.0).alias("h"), spatial.band(F.col("x"), F.col("y"), 1, 0, 0.5, 0.1, 4.0).alias("b")).first()
    assert (row.h, row.b) == (9.0, 4.0)


def test_GR8_components_of_chains_and_nulls(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(10, 40)] + [("a", "b"), ("c", "c"), (None, "a")], "a string, b string")
    got = {r.node: r.component for r in network.components(edges).collect()}
    assert {got[str(i)] for i in range(10, 41)} == {"10"} and got["b"] == "a" and got["c"] == "c"


def test_components_of_a_falling_chain_take_few_jobs(spark):
    """The smallest node lies beyond the chain's largest name: its label moved on by one link a round, which took two jobs or more."""
    names = ["000", *[f"{k:03d}" for k in range(120, 0, -1)]]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.node: r.component for r in network.components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert got == dict.fromkeys(names, "000")
    assert jobs < 200


def test_PRJ_keys(spark):
    df = spark.createDataFrame([("7.0", "Truck", "3"), (" 00123 ", "1", "sctg2033"), ("1234567", "2", "34")], "k string, m string, c string")
    out = df.select(keys.fips(F.col("k")).alias("f"), keys.zone(F.col("k")).alias("z"), keys.last_five_digits(F.col("k")).alias("l"), keys.mode_is(F.col("m"), "truck").alias("t"), keys.commodity_group(F.col("c")).alias("g"), keys.safe_event_id(F.lit(" a-b ")).alias("e"), keys.number("k", 0.0).alias("n")).collect()
    assert [tuple(r) for r in out] == [("00007", "7", "00070", True, "sctg0109", "a-b", 7.0), ("00123", "123", "00123", True, "sctg2033", "a-b", 123.0), ("1234567", "1234567", "34567", False, "sctg3499", "a-b", 1234567.0)]
    assert keys.rename_aliases(df, {"code": ["K", "x"]}).columns == ["code", "m", "c"]
    assert keys.year_column(df.withColumnRenamed("k", "tons_2022"), "tons", 2022) == "tons_2022"
    with pytest.raises(ValueError):
        keys.require(df, ["k", "nope"])


def test_MT_levels_grow_with_intensity(spark):
    x = spark.range(0, 800).withColumn("v", F.col("id") / 100.0)
    for hazard in damage.THRESHOLDS:
        scale = 1.0 if hazard in damage.FLOODS or hazard == "earthquake" else 100.0
        rows = x.select(damage.ordinal(F.col("v") * scale, hazard, F.lit(True)).alias("a"), damage.ordinal(F.col("v") * scale, hazard, F.lit(False)).alias("b")).collect()
        assert all(p.a <= q.a and p.b <= q.b for p, q in zip(rows, rows[1:])) and rows[0].a == rows[0].b == 0 and rows[-1].b >= rows[-1].a
    assert spark.range(1).select(damage.ordinal(F.lit(None).cast("double"), "river", F.lit(False)).alias("n")).first().n == 0


def test_WN1_ids_and_JN26_nearest(spark):
    pairs = od(spark, [(f"o{i % 7}", f"d{i:03d}", 1.0) for i in range(300)])
    got = sorted((r.origin, r.destination, r.od_id) for r in demand.surrogate_ids(pairs, 100, 8).collect())
    assert [g[2] for g in got] == list(range(100, 400))
    left = spark.createDataFrame([(1, 10.0, 50.0), (2, -170.0, 10.0)], "id long, lon double, lat double")
    right = spark.createDataFrame([(7, 10.5, 50.0), (8, 10.5, 50.0), (9, -60.0, -10.0)], "id long, lon double, lat double")
    assert {r.id: r.near_id for r in demand.nearest(left, right).collect()} == {1: 7, 2: 9}


def test_SRC_readers(spark, tmp_path):
    (tmp_path / "net.tntp").write_text("<NUMBER OF LINKS> 2\n<END OF METADATA>\n\n~ init term\n1\t2\t100.5\t3\t4\t0.15\t4\t0\t0\t1\t;\n2 1 50 3 4 .15 4 0 0 1 ;\n")
    (tmp_path / "trips.tntp").write_text("<TOTAL OD FLOW> 30\n<END OF METADATA>\n\nOrigin  1\n    1 : 0.0;   2 : 10.0;\nOrigin 2\n    1 : 20.0;\n")
    (tmp_path / "c.csv").write_text(" code ,n\n007,1\n")
    links = tables.read_tntp_links(spark, str(tmp_path / "net.tntp")).collect()
    assert [(r.init, r.term, r.capacity) for r in links] == [("1", "2", 100.5), ("2", "1", 50.0)]
    assert sorted(tuple(r) for r in tables.read_tntp_trips(spark, str(tmp_path / "trips.tntp")).collect()) == [("1", "2", 10.0), ("2", "1", 20.0)]
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "c.csv")).collect()] == [("007", "1")]
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.xlsx")


def test_report_and_exposure_small(spark):
    df = spark.createDataFrame([(1, 1e3), (2, 2.5e6), (3, 12.0)], "k int, v double")
    assert [r.c for r in df.orderBy("k").select(report.shown_cost(F.col("v")).alias("c")).collect()] == ["$1.0K", "$2.5M", "$12.0"]
    one = df.select(exposure.closed(F.col("v"), F.lit(0.0)).alias("a"), exposure.closed(F.col("v"), F.lit(None)).alias("b"), exposure.damaged([], F.lit(0.1)).alias("c"), demand.half_even(F.lit(2.5)).alias("d")).first()
    assert (one.a, one.b, one.c, one.d) == (0.0, 1e3, True, 2)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name,most", [("disrupted_pairs", 4), ("disrupted_edge_flow", 3), ("path_index_candidates", 3), ("stored_index_candidates", 3), ("assignment_costs", 15)])
def test_steps_are_not_shuffled(spark, name, most):
    """What meets the steps of paths goes to them, where it is a table of links; Spark knows no sizes here, as of large tables."""
    from roadweave.plans.queries import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows", [0, 1000])
def test_disrupted_paths_are_the_candidates(spark, monkeypatch, rows):
    from roadweave import session

    monkeypatch.setattr(session, "WHOLE_ROWS", rows)
    paths = spark.createDataFrame([(i, float(i % 9), f"o{i % 3}", [f"e{(i * k) % 11}" for k in range(i % 5)]) for i in range(200)], "od_id long, flow double, origin string, path array<string>")
    damaged = spark.createDataFrame([("a", "e1"), ("a", "e1"), ("a", "e4"), ("b", "e4"), ("b", "e0"), ("b", None), ("c", "e9"), ("d", "e77")], "event string, e_id string")
    cap = spark.createDataFrame([("e1", 2.0), ("e4", 5.0), ("e4", 3.0), ("e9", None)], "e_id string, capacity double")
    want = sorted(map(tuple, inc.disrupted(inc.event_candidates(paths, damaged), cap).join(paths.select("od_id", "origin"), "od_id").select("event", "od_id", "origin", "disrupted").collect()))
    assert sorted(map(tuple, inc.disrupted_paths(paths, damaged, cap, ["origin"]).collect())) == want and len(want) > 10


def test_segments_are_split_as_lines():
    """Many segments in one pass of arrays give the pieces of each alone: on borders, upright, level, without length."""
    import numpy as np

    rng = np.random.default_rng(3)
    ends = np.concatenate([rng.uniform(-5, 9, (300, 4)), rng.integers(-3, 6, (200, 4)) / 2, [[1, 1, 1, 1], [0, 0, 3, 0], [2, 5, 2, -1]]])
    got = [[] for _ in ends]
    for s, c, q, n in zip(*(a.tolist() for a in spatial.split_segments(*ends.T, -1.0, 0.5, 0.7, 1.0))):
        got[s].append((c, q, n))
    assert got == [spatial.split_line([(a, b), (c, d)], -1.0, 0.5, 0.7, 1.0) for a, b, c, d in ends.tolist()]


def test_lines_of_grid_with_nulls_and_points(spark):
    lines = spark.createDataFrame([("a", [(0.5, 0.5), (2.5, 0.5), (2.5, 1.5)]), ("b", [(0.1, 0.1)]), ("c", []), ("d", [(3.0, 0.2), (3.5, 0.2)])], "e_id string, vertices array<struct<x: double, y: double>>")
    cells = spark.createDataFrame([(0, 0, 5.0)], "col int, row int, value double")
    got = sorted((r.e_id, r.split_id, r.col, r.row, r.length, r.value) for r in spatial.intersect_grid(lines, cells, 0, 0, 1, 1).collect())
    assert got == [("a", 0, 0, 0, 0.5, 5.0), ("a", 1, 1, 0, 1.0, None), ("a", 2, 2, 0, 0.5, None), ("a", 3, 2, 0, 0.5, None), ("a", 4, 2, 1, 0.5, None), ("d", 0, 3, 0, 0.5, None)]
