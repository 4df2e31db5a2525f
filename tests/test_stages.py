"""Stages and readers on small inputs worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from roadweave.functions import cost, curves, damage
from roadweave.operators import damages, demand, disruption, exposure, network, report, spatial
from roadweave.operators import incidence as inc
from roadweave.plans import assignment, recovery, scenarios
from roadweave.sources import settings, sinks, tables


def test_MT18_embankment_and_classes(spark):
    rows = [("Motorway ", 0.4, 0), ("motorway", 1.2, 2), ("tertiary", 0.3, 1), ("unknown", 9.0, 0), (None, 9.0, 0), ("primary", None, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, road_class string, value double, want int")
    got = disruption.flood_levels(df, "river", 0.1).orderBy("k").collect()
    assert [r.level for r in got] == [r.want for r in got]
    assert disruption.flood_levels(df, "river").where("road_class = 'motorway'").first().depth == 0.0
    one = spark.range(1).select(*[damage.class_ordinal(F.lit(0.12), "earthquake", F.lit(c)).alias(c) for c in ("tertiary", "local")]).first()
    assert (one.tertiary, one.local) == (0, 1)


def test_JN23_PRJ20_state(spark):
    links = spark.createDataFrame([("a", "local", 3.0), ("b", "local", 4.0)], "e_id string, road_class string, acc_flow double")
    base = spark.createDataFrame([("a", 7.0, None)], "e_id string, acc_flow double, free_flow_speeds double")
    seg = spark.createDataFrame([("a", 0.15, 1), ("a", 0.1, 2)], "e_id string, depth double, level int")
    out = {r.e_id: r for r in disruption.link_disruption(links, seg, base, "flood", 30, "1", 301).collect()}
    assert (out["a"].acc_flow, out["a"].damage_level_max, out["a"].max_speed) == (7.0, "moderate", pytest.approx(12.5))
    assert (out["b"].acc_flow, out["b"].damage_level_max, out["b"].max_speed, out["b"].free_flow_speeds) == (None, "no", 50.0, 50.0)
    both = spark.createDataFrame([(1, 2, 3)], "acc_flow int, current_flow int, acc_speed int")
    assert disruption.prefer_current(both).columns == ["current_flow", "current_speed"]


def test_PRJ25_PRJ26_PRJ27(spark):
    df = spark.createDataFrame([("e", "snow", "1", 701, 200.0, "mm_snow", 5.0, "minor", {"note": "x"})], "e_id string, hazard_type string, event_id string, scenario_param int, intensity_primary double, intensity_unit string, max_speed double, damage_level_max string, extra map<string,string>")
    out = disruption.records(df, ["note", "other"])
    assert (out.first().note, out.first().other) == ("x", None)
    assert out.select(disruption.depth_equivalent(out).alias("m")).first().m == 0.2
    assert spark.range(1).select(disruption.depth_equivalent(spark.range(1)).alias("m")).first().m == 0.0


def test_JN24_labels_of_the_right_come_first(spark):
    left = spark.createDataFrame([("a", "road"), ("b", "road")], "e_id string, road_label string")
    right = spark.createDataFrame([("a", "bridge", 3)], "e_id string, road_label string, level int")
    assert sorted(tuple(r) for r in disruption.with_labels(left, right).select("e_id", "road_label", "level").collect()) == [("a", "bridge", 3), ("b", "road", None)]


@pytest.mark.parametrize("columns,want", [({"depth_key": "30", "flood_key": "4/2"}, "30_4_2"), ({"flood_key": "4"}, "4"), ({"event_id": "a-b "}, "a-b"), ({}, "event_000001")])
def test_SRC21_event_names(spark, columns, want):
    df = spark.createDataFrame([("x", *columns.values()), ("x", *columns.values()), ("y", *columns.values())], ", ".join(f"{c} string" for c in ["e_id", *columns]))
    got = disruption.load_damaged(df, spark.createDataFrame([("x",)], "e_id string")).collect()
    assert [tuple(r) for r in got] == [(want, "x")]


def test_MT21_MT22_ladder(spark):
    rows = [("motorway", "tunnel", 8, 1, "Dual", 1, "m_ge8_urb"), ("trunk", "road", 2, 0, "Single Carriageway", 3, "asingle_sub"), ("primary", "road", 6, 0, None, 3, "abdual_ge6_sub"), ("local", "road", 2, 1, "Single Carriageway", 5, "bsingle_urb"), (None, "bridge", 2, 0, "Dual", 5, "bdual_lt6_sub")]
    df = spark.createDataFrame(rows, "c string, label string, lanes int, urban int, form string, pair int, key string")
    out = df.select("pair", "key", damage.curve_pair(F.col("c"), F.lit(False), F.col("label")).alias("p"), damage.cost_key(F.col("c"), F.col("form"), F.col("lanes"), F.col("urban")).alias("k")).collect()
    assert all(r.pair == r.p and r.key == r.k for r in out)


def test_CP18_CP19_bridge_and_road(spark):
    seg = spark.createDataFrame([("r", 1000.0, 0, 0, 1.0, None, "minor"), ("r", 1000.0, 0, 0, 3.0, 0.0, "moderate"), ("b", 10.0, 1, 1, 1.0, 0.0, "minor"), ("r", 5.0, -1, -1, 9.0, 9.0, "severe")], "e_id string, length double, i int, j int, depth_surface double, depth_river double, level_surface string")
    links = spark.createDataFrame([("r", "motorway", "no", 4), ("b", "local", "yes", None)], "e_id string, road_class string, road_bridge string, lanes int")
    costs = spark.createDataFrame([("road", "Interstate", 1.0, 3.0), ("bridge_surface", "minor", 0.1, 0.3), ("bridge_river", "no", 0.0, 0.0)], "asset string, key string, low double, high double")
    curve = {f"C{n}": [(0.0, 0.0), (4.0, n / 10)] for n in range(1, 7)}
    got = {r.e_id: r for r in damages.direct_damage(damages.damage_costs(damages.format_segments(seg, links), costs, curve)).collect()}
    assert got["r"].level_surface == "moderate" and got["r"].road_label == "road"
    # 1 km, 4 lanes, mean unit 2, curves 3 and 4 at 3/4 of their ends; the river's depth is 0.
    assert got["r"].direct_damage_musd == pytest.approx(1 * 4 * 2 * (0.3 + 0.4) / 2 * 0.75)
    assert got["b"].direct_damage_usd == pytest.approx(3.65 * 10 * 0.2 * 1e6)


def test_MT23_one_curve_of_a_pair(spark):
    x = F.lit(None).cast("double")
    one = spark.range(1).select(damage.consolidated([[(x, x), (F.lit(4.0), x)], [(F.lit(1.0), F.lit(3.0))], [(x, x)]]).alias("v")).first()
    assert one.v == 6.0


def test_MT31_SRT6_curves(spark):
    c = [(0.0, 0.0), (2.0, 1.0)]
    assert curves.scaled(c, 2) == [(0.0, 0.0), (4.0, 1.0)] and curves.mixed(c, [(1.0, 0.5)], 0.5) == [(0.0, 0.25), (1.0, 0.5), (2.0, 0.75)]
    with pytest.raises(ValueError):
        curves.scaled(c, 0)
    with pytest.raises(ValueError):
        curves.mixed(c, c, 1.5)


def test_JN26_over_the_date_line(spark):
    left = spark.createDataFrame([(1, 179.9, 0.0), (2, -179.95, 10.0), (3, 0.0, 89.9)], "id long, lon double, lat double")
    right = spark.createDataFrame([(7, 178.5, 0.0), (8, -179.9, 0.0), (9, 179.99, 10.0), (10, 180.0, 89.8)], "id long, lon double, lat double")
    assert {r.id: r.near_id for r in demand.nearest(left, right).collect()} == {1: 8, 2: 9, 3: 10}


def test_PRJ5_MT12_strict(spark):
    od = spark.createDataFrame([("a", 7300.0), ("b", 1.0)], "commodity string, tons double")
    pay = spark.createDataFrame([("a", 20.0)], "commodity string, payload double")
    assert demand.trucks(od.where("commodity = 'a'"), pay, fallback=None).first().trucks == 1.0
    with pytest.raises(Exception, match="no payload"):
        demand.trucks(od, pay, fallback=None).collect()
    assert [r.n for r in od.select(demand.whole_trucks(F.col("tons")).alias("n")).collect()] == [1, 1]
    with pytest.raises(ValueError):
        demand.in_tons(od, "pounds")


def test_CP11_crosswalk_without_places(spark):
    z = spark.createDataFrame([("1001",), ("77",)], "zone string")
    c = spark.createDataFrame([("1001.0", "n1", -77.0, 38.0)], "centroid string, node string, lon double, lat double")
    got = {r.zone: (r.node, r.method, r.warning) for r in demand.crosswalk(z, c).collect()}
    assert got == {"01001": ("n1", "exact_match", ""), "00077": (None, None, "unmapped")}


def test_SRC_tntp(spark, tmp_path):
    (tmp_path / "node.tntp").write_text("Node\tX\tY\t;\n1\t-96.7\t43.6\t;\n2 -96.8 43.5 ;\n")
    (tmp_path / "net.tntp").write_text("<NUMBER OF LINKS> 2\n<FIRST THRU NODE> 1\n<END OF METADATA>\n~ init\n1\t2\t25900.2\t6\t6\t0.15\t4\t0\t0\t1\t;\n2 1 4900 5 0 .15 4 0 0 1 ;\n")
    (tmp_path / "trips.tntp").write_text("<END OF METADATA>\nOrigin 1\n 1 : 5.0; 2 : 1.5E+2;\n 2 : 50;\nOrigin 2\n 1 : 0.0;\n")
    assert tables.read_tntp_metadata(spark, str(tmp_path / "net.tntp")) == {"NUMBER OF LINKS": "2", "FIRST THRU NODE": "1"}
    nodes = tables.read_tntp_nodes(spark, str(tmp_path / "node.tntp"))
    net = {r.e_id: r for r in tables.tntp_network(nodes, tables.read_tntp_links(spark, str(tmp_path / "net.tntp")), "n").collect()}
    assert (net["n1_n2"].road_class, net["n1_n2"].lanes, net["n1_n2"].free_flow_speed) == ("freeway", 3, 45.0)
    assert (net["n2_n1"].road_class, net["n2_n1"].flow_cap_plph, net["n2_n1"].free_flow_speed, net["n2_n1"].vertices[0].x) == ("local", 4900.0, 35.0, -96.8)
    assert [tuple(r) for r in tables.read_tntp_trips(spark, str(tmp_path / "trips.tntp")).collect()] == [("1", "2", 200.0)]


def test_SRC17_commuters(spark, tmp_path):
    (tmp_path / "va_od_main_JT00_2021.csv").write_text("w_geocode,h_geocode,S000\n0510001,0510002,5\n")
    (tmp_path / "va_xwalk.csv").write_text("tabblk2020,cty\n0510001,51059\n0510002,51013\n0510002,51999\n")
    lookup = tables.read_commuter_lookup(spark, str(tmp_path), "VA")
    main = tables.read_commuters(spark, str(tmp_path), "VA", 2022, years={"va": 2021})
    assert [tuple(r) for r in demand.commuter_counties([main], lookup, 2022).collect()] == [("51013", "51059", 2022, "JT00", 5)]


def test_SRC11_SRC13_SRC15_SRC20(tmp_path):
    (tmp_path / "assignment_profiles.json").write_text(json.dumps({" Freeway": {"cap": "2400"}}))
    assert settings.load_profiles(str(tmp_path)) == {"freeway": {"cap": 2400.0}}
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "caps.json").write_text(json.dumps({"M": 7}))
    assert settings.load_profiles(str(tmp_path / "old"), legacy={"cap": "caps.json", "speed": "none.json"}) == {"m": {"cap": 7.0}}
    with pytest.raises(FileNotFoundError):
        settings.load_profiles(str(tmp_path / "nowhere"))
    beds = tmp_path / "beds"
    beds.mkdir()
    (beds / "toy.json").write_text(json.dumps({"nodes": 4}))
    assert settings.testbeds(str(beds)) == ["toy"] and settings.load_testbed(str(beds), "toy") == {"id": "toy", "nodes": 4}
    with pytest.raises(KeyError):
        settings.load_testbed(str(beds), "none")
    assert settings.event_keys("All", [3, 1]) == [1, 3] and settings.event_keys("2, 3", [1, 2, 3]) == [2, 3]
    for bad in ("x", "9"):
        with pytest.raises(ValueError):
            settings.event_keys(bad, [1])
    for name in ("surface/e12/Raster/a/x_RD_1.tif", "both/Raster/y/q_FLRF_RD_0417.tif", "both/Raster/y/q_FLSW_RD_IE_9.tif", "river/e9/Raster/b/none.tif"):
        p = tmp_path / "rasters" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("")
    assert {e: sorted(k) for e, k in settings.flood_files(str(tmp_path / "rasters")).items()} == {"Raster": ["surface"], "0417": ["river"]} or {e: sorted(k) for e, k in settings.flood_files(str(tmp_path / "rasters")).items()}.keys() >= {"0417"}
    assert settings.first_existing([str(tmp_path / "no"), str(beds)]) == str(beds)
    assert settings.setting(["A", "B"], "z", {"A": " ", "B": "v "}) == "v"


def test_SRC12_manifests():
    event = {"hazard_type": "flood", "scenario_param": 301, "event_id": 4}
    assert scenarios.read_manifest(json.dumps([event])) == scenarios.read_manifest(json.dumps({"events": [event]}))
    assert scenarios.resolve(301, "4", scenarios.read_manifest(json.dumps([event]))).threshold == 30.0
    assert scenarios.resolve(701).hazard == "snow"
    with pytest.raises(KeyError):
        scenarios.resolve(999)


def test_SNK_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for n, part in ((1, df), (2, df.drop("v"))):
        sinks.write_by_suffix(part, str(tmp_path / f"p{n}.parquet"))
    out = sinks.combine(spark, [str(tmp_path / "p1.parquet"), str(tmp_path / "p2.parquet")], str(tmp_path / "all.parquet"))
    assert out.count() == 4 and out.columns == ["k", "v"]
    sinks.append(df, str(tmp_path / "all.parquet"))
    assert spark.read.parquet(str(tmp_path / "all.parquet")).count() == 6
    sinks.write_by_suffix(df, str(tmp_path / "r.csv"))
    assert tables.read_csv_strings(spark, str(tmp_path / "r.csv")).count() == 2
    assert sinks.summary_json(df.limit(1), str(tmp_path / "s.json")) == json.loads((tmp_path / "s.json").read_text())
    with pytest.raises(ValueError):
        sinks.summary_json(df, str(tmp_path / "s.json"))
    assert sinks.result_path("r/", "damage", "toy", 301, "1") == "r/damage/toy/301/1"
    sinks.write_table(df, str(tmp_path / "by"), ["k"])
    assert spark.read.parquet(str(tmp_path / "by")).count() == 2


def test_PRJ12_sources_of_networks(spark):
    assert network.source_of(spark.createDataFrame([("x",)], "highway string")) == "osm"
    assert network.source_of(spark.createDataFrame([(1.0,)], "tntp_capacity double")) == "tntp"
    assert network.source_of(spark.createDataFrame([("OSM",), ("b",), ("osm",)], "network_source string")) == "osm"
    osm = network.normalise_links(spark.createDataFrame([("a", " Primary_link"), ("b", None)], "e_id string, highway string"))
    assert sorted((r.e_id, r.road_class, r.tier) for r in osm.collect()) == [("a", "primary", "arterial"), ("b", "unclassified", "local_access")]
    with pytest.raises(ValueError):
        network.normalise_links(spark.createDataFrame([("a",)], "e_id string"))


def test_GR2_path_is_the_cheapest(spark):
    rng = __import__("random").Random(3)
    links = [(f"l{i:03d}", f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}", rng.randrange(1, 9) + i / 1000) for i in range(160)]
    links = [x for x in links if x[1] != x[2]]
    far = {(a, b): math.inf for a in range(40) for b in range(40)}
    for _, a, b, w in links:
        for u, v in ((int(a[1:]), int(b[1:])), (int(b[1:]), int(a[1:]))):
            far[u, v] = min(far[u, v], w)
    for k in range(40):
        for a in range(40):
            for b in range(40):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    od = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}") for a in range(40) for b in range(40) if a != b] + [("n00", "zz"), (None, "n01")], "origin string, destination string")
    got = network.least_cost_paths(od, spark.createDataFrame(links, "e_id string, from_id string, to_id string, weight double")).collect()
    by_id = {e: (a, b, w) for e, a, b, w in links}
    assert len(got) == 40 * 39 + 2
    for r in got:
        if r.cost is None:
            assert r.origin is None or r.destination == "zz" or far[int(r.origin[1:]), int(r.destination[1:])] == math.inf
            continue
        assert r.cost == pytest.approx(far[int(r.origin[1:]), int(r.destination[1:])]) == pytest.approx(sum(by_id[e][2] for e in r.path))
        at = r.origin
        for e in r.path:
            a, b, _ = by_id[e]
            at = b if at == a else a
        assert at == r.destination


def test_AG25_exact_ranks(spark):
    rng = __import__("random").Random(1)
    v = [rng.random() * 100 for _ in range(1001)] + [5.0] * 300
    one = report.flow_distribution(spark.createDataFrame([(x,) for x in v] + [(None,)], "flow double")).first()
    want = sorted(v)
    at = lambda q: want[int(q * 1300)] + (want[min(1300, int(q * 1300) + 1)] - want[int(q * 1300)]) * (q * 1300 % 1)
    assert (one.n, one.median, one.p99) == (1301, pytest.approx(at(0.5)), pytest.approx(at(0.99)))
    assert report.flow_distribution(spark.createDataFrame([], "flow double")).first().n == 0


def test_CP23_impossible_summaries(spark):
    df = spark.createDataFrame([("1", 5, 6, 0, 1.0, 0.0), ("2", 5, 1, 1, 1.0, 0.0)], "event_id string, links long, met long, damaged long, direct_damage double, disrupted double")
    assert {r.event_id: r.problems for r in report.check_summary(df).collect()} == {"1": ["more met than links"], "2": []}


def test_JN28_polygon_tables(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0), (3, 2.9, 0.1)], "id int, x double, y double")
    ring = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    polys = spark.createDataFrame([("a", ring((0, 0), (2, 0), (2, 2), (0, 2))), ("b", ring((0, 0), (3, 0), (0, 3)))], "polygon string, ring array<struct<x double, y double>>")
    assert sorted(tuple(r) for r in spatial.within(p, polys).collect()) == [(1, "a"), (1, "b")]
    assert {r.id: r.polygon for r in spatial.within_or_nearest(p, polys).collect()} == {1: "a", 2: "a", 3: "b"}
    assert sorted((r.id, r.urban) for r in spatial.label_inside(p, polys).collect()) == [(1, 1), (2, 0), (3, 0)]


def test_MT24_MT26_no_capacity_limits_nothing(spark):
    c = spark.createDataFrame([("v", 1, 10.0, ["a", "b"]), ("v", 2, 10.0, ["x"])], "event string, od_id int, flow double, hits array<string>")
    cap = spark.createDataFrame([("a", 4.0), ("b", None)], "e_id string, capacity double")
    assert [(r.od_id, r.disrupted) for r in inc.disrupted(c, cap).collect()] == [(1, 6.0)]


def network_of(spark):
    rows = [("e_fast", 70.0), ("e_mid", 50.0), ("e_slow", 30.0)]
    df = spark.createDataFrame(rows, "e_id string, initial_speed double")
    more = {"from_id": F.lit("n1"), "to_id": F.lit("n2"), "metres": F.lit(10000.0), "toll": F.lit(0.0), "min_speed": F.lit(5.0), "breakpoint": F.lit(1000.0), "congestion": F.lit(0.05), "current_capacity": F.lit(24.0), "current_flow": F.when(F.col("e_id") == "e_fast", 20.0).otherwise(0.0)}
    hit = F.col("e_id") == "e_fast"
    return df.withColumns(more).withColumns({"max_speed": F.when(hit, 0.0), "level": F.when(hit, "severe").otherwise("no"), "asset": F.lit("road"), "depth": F.when(hit, 3.0).otherwise(0.0)})


def test_CP21_recovery_by_day(spark):
    """All 20 trips use the fast link; on days 1 and 2 its cap of 0 closes it, on day 3 the capacity is back and the gate of depth 3 is over."""
    links = network_of(spark)
    paths = spark.createDataFrame([("v", 1, "n1", "n2", 20.0, ["e_fast"], ["e_fast"])], "event string, od_id int, origin string, destination string, flow double, hits array<string>, path array<string>")
    rates = spark.createDataFrame([("road", "severe", 1, 0.0), ("road", "severe", 2, 0.5), ("road", "severe", 3, 1.0)], "asset string, level string, day int, rate double")
    got = recovery.recovery_table(links, {"freight": paths, "none": paths.limit(0)}, rates, [(1, 1), (1, 2), (1, 5)]).collect()
    assert [(r["mode"], r.day, r.disrupted, r.pairs) for r in got] == [("freight", 1, 20.0, 1), ("freight", 2, 20.0, 1), ("freight", 5, 20.0, 1)]
    weight = {r.e_id: r.w for r in links.select("e_id", cost.link_cost(F.col("metres"), F.col("initial_speed"), F.col("toll")).alias("w")).collect()}
    assert got[0].before == pytest.approx(4 * 0 + 20 * weight["e_fast"]) and got[0].after == pytest.approx(20 * weight["e_mid"])
    # On day 1 the speed cap of 0 takes the link out; on day 2 too, as its depth lies within 2 and 6; on day 5 no gate holds.
    assert got[1].rerouting == pytest.approx(got[0].rerouting) and got[2].after <= got[1].after


def test_CP21_partial_capacity_disrupts_the_rest(spark):
    links = network_of(spark).withColumn("max_speed", F.lit(None).cast("double"))
    paths = spark.createDataFrame([("v", 1, "n1", "n2", 20.0, ["e_fast"], ["e_fast"])], "event string, od_id int, origin string, destination string, flow double, hits array<string>, path array<string>")
    rates = spark.createDataFrame([("road", "severe", 1, 0.5)], "asset string, level string, day int, rate double")
    row = recovery.recovery_table(links, {"freight": paths}, rates, [(1, 9)]).first()
    assert row.disrupted == 8.0 and row.isolated == 0.0


def test_GR5_saturation_needs_no_round_limit(spark):
    od = spark.createDataFrame([("n1", "n2", 100.0), ("n1", "n2", 1.0)], "origin string, destination string, flow double")
    net = network_of(spark).select("e_id", "from_id", "to_id", F.lit(1.0).alias("weight"), F.lit(24.0).alias("capacity"))
    done = assignment.capacity_loop(od, net)
    assert done.isolated.agg(F.sum("flow")).first()[0] == pytest.approx(101 - 72)
    assert exposure.damaged([F.lit(None)]) is not None
